"""Token counts by source, language and tokenizer version, kept current by signed changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.llm.common import slices, text_buffer
from flowrisk.llm.tokens import encoder

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, batch_id string"
#: Text encoded at once in a task.
SLICE_BYTES = 8 << 20


def token_counts(docs: DataFrame, file: str, keep: list[str], by_word: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``n_tokens`` of the whole ``text`` (null: 0), by a tokenizer file.

    ``by_word`` is for tokenizers that drop white space (see ``tokens.WordEncoder``).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file, by_word)
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.num_columns - 1))
            text = data.tobytes()
            n: list[int] = []
            for a, b in slices(offsets, SLICE_BYTES):
                n += enc.encode([text[offsets[i] : offsets[i + 1]] for i in range(a, b)])[1].tolist()
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(count, f"{schema}, n_tokens long")


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.lit(sign).alias("docs"), (F.lit(sign) * F.col("n_tokens")).alias("tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add documents; ``counts`` has the keys and ``n_tokens`` of each."""
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take back documents that were added with these counts."""
    return _signed(counts, -1)


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes from old counts to new ones: the old rows with a minus, the new rows with a plus."""
    return deletes(before).unionAll(inserts(after))


class Rollup:
    """Additive totals in a folder with one partition of deltas per committed batch.

    ``commit`` adds a batch's signed changes up and replaces the partition of its id as a
    whole, so a batch that is delivered or retried again counts once, also if it now has other rows or none. A commit that failed
    before its files were moved in place counts not at all; one that was cut off while they were moved has to be
    delivered again. ``totals`` adds the deltas up: batches commute. Null sources, languages and versions
    are keys of their own; a key whose documents have all gone has no row; an empty batch
    changes nothing. Deltas are summed on the map side, so a hot source costs one row per task.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commit(self, batch_id: str, changes: DataFrame) -> None:
        delta = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        # A row of zeros keeps the partition in the data, as only partitions that occur are replaced.
        nothing = self.spark.range(1).select(*[F.lit(None).cast("string").alias(k) for k in KEYS], F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("tokens"))
        writer = delta.unionByName(nothing).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.path)

    def deltas(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def totals(self) -> DataFrame:
        sums = self.deltas().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 or tokens <> 0")
