"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.llm import (
    decontamination, divergence, html_text, licenses, mixing, near_text, near_vectors, sharding, sql, suffix_dedup, token_counts, token_files,
    toxicity, vector_codes,
)
from flowrisk.llm.common import text_key
from flowrisk.session import shared_dir, write_table

#: Path of a public tokenizer file by name.
TOKENIZER = public_tokenizers.path
SHARDS, SEED = 40, 1
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place."""
    return f"{shared_dir(spark)}/flowrisk/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents: load with word counts, revision to counts of the public
    tokenizer, deletion of later exact copies; the revision is delivered twice."""
    docs = _table(spark, sf_dir, "documents").withColumn("words", mixing.tokens(F.col("text")) - 1)
    k1, k2 = text_key(F.col("text"))
    docs = docs.withColumn("k1", k1).withColumn("k2", k2)
    keep = ["doc_id", "source", "lang", "words", "k1", "k2"]
    counted = write_table(token_counts.token_counts(docs, TOKENIZER("word_bpe_49k.json"), keep, by_word=True), "counts")
    words = counted.select("source", "lang", F.lit("words-1").alias("tokenizer"), F.col("words").alias("n_tokens"))
    ids = counted.withColumn("tokenizer", F.lit("word_bpe_49k"))
    rollup = token_counts.Rollup(spark, _folder(spark, "token-counts"))
    rollup.commit("0001-load", token_counts.inserts(words))
    for _ in range(2):
        rollup.commit("0002-revision", token_counts.revisions(words, ids))
    firsts = counted.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = ids.join(firsts.drop("n"), ["k1", "k2"]).filter("doc_id > first")
    rollup.commit("0003-copies", token_counts.deletes(copies))
    return rollup.totals()


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    sharded = sharding.shard(docs, ["doc_id", "size", "text_crc32"], SHARDS, SEED)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, lexicon, ["doc_id"]).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "n_hits")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), path, TOKENIZER("word_bpe_49k.json"), END_ID, by_word=True)
    return token_files.read_digests(spark, path).withColumnRenamed("key", "doc_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here copies go in all places, the first one included."""
    return suffix_dedup.digest(suffix_dedup.without_repeats(_table(spark, sf_dir, "documents"), keep_first=False))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = html_text.train(html_text.training_set())
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract(pages, field, ["page_id", "url"])


def op8_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = mixing.mixed(_table(spark, sf_dir, "documents"))
    return sampled.select("doc_id", "source", "lang", "topic", "tokens", F.round("rate", 6).alias("rate"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document: the contract's phrases and the labels of public notices."""
    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the others of its language, and its ten most telling terms."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors with their errors, and the digest of the codebooks."""
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


def _overlaps_sql() -> str:
    """The same seeds as lists of words, joined as text, and the same stretches."""
    masks = decontamination.MASKS
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"
    span, stretch, percent = decontamination.SPAN, decontamination.STRETCH, decontamination.MATCHED

    def windows(side: str, key: str) -> str:
        parts = [
            f"SELECT {key}, {n} AS mask, i, concat_ws(' ', {', '.join(f'w[i + {k}]' for k in m)}) AS seed "
            f"FROM (SELECT *, unnest(range(1, len(w) - {span} + 2)) AS i FROM {side})"
            for n, m in enumerate(masks)
        ]
        short = " OR ".join(f"len(w) = {k}" for k in range(1, span))
        if side == "b":
            parts.append(f"SELECT {key}, 100 + len(w) AS mask, 1 AS i, array_to_string(w, ' ') AS seed FROM b WHERE {short}")
        else:
            parts.append(
                f"SELECT {key}, 100 + k AS mask, i, array_to_string(w[i:i + k - 1], ' ') AS seed "
                f"FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT len(w) AS k FROM b WHERE {short}))"
            )
        return " UNION ALL ".join(parts)

    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    b AS (SELECT * FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
    laid AS (
      SELECT DISTINCT x.doc_id, y.item_id, x.i - y.i AS shift
      FROM ({windows("d", "doc_id")}) x JOIN ({windows("b", "item_id")}) y ON x.mask = y.mask AND x.seed = y.seed),
    agree AS (
      SELECT doc_id, item_id, shift, len(b.w) AS n,
             list_transform(range(1, len(b.w) + 1), lambda i: CASE WHEN shift + i >= 1 AND d.w[shift + i] = b.w[i] THEN 1 ELSE 0 END) AS a
      FROM laid JOIN d USING (doc_id) JOIN b USING (item_id)),
    best AS (
      SELECT doc_id, item_id, shift, n, list_sum(a) AS matched, least({stretch}, n) AS wide,
             list_max(list_transform(range(1, n - least({stretch}, n) + 2), lambda i: list_sum(a[i:i + least({stretch}, n) - 1]))) AS top
      FROM agree)
    SELECT doc_id, item_id, CAST(-t.shift AS INTEGER) AS "at", CAST(t.matched AS INTEGER) AS matched, CAST(t.n AS INTEGER) AS item_words
    FROM (SELECT doc_id, item_id, max({{'matched': matched, 'shift': -shift, 'n': n}}) AS t FROM best WHERE top * 100 >= wide * {percent} GROUP BY ALL)"""


def _mixed_sql(rounds: int = 30) -> str:
    n = r"CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda w: w <> '')) + 1 AS BIGINT)"
    dims = list(mixing.TEMPER)
    steps = ["d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, " + n + " AS tokens FROM documents)"]
    steps.append(
        "r AS (SELECT doc_id, source, lang, tokens, CASE WHEN contains(text, ' | ') THEN 'table' "
        "WHEN regexp_matches(text, '%%%|###|&&&') THEN 'noise' WHEN tokens <= 50 THEN 'note' ELSE 'prose' END AS topic FROM d)"
    )
    steps.append(f"c AS (SELECT {', '.join(dims)}, CAST(sum(tokens) AS DOUBLE) AS tokens FROM r GROUP BY ALL)")
    for d, p in mixing.TEMPER.items():
        steps.append(f"p_{d} AS (SELECT {d}, pow(sum(tokens), {p}) AS p FROM c GROUP BY {d})")
        steps.append(f"g_{d} AS (SELECT {d}, p / (SELECT sum(p) FROM p_{d}) AS goal FROM p_{d})")
    steps.append("w0 AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM c) AS weight FROM c)")
    at = 0
    for _ in range(rounds):
        for d in dims:
            steps.append(
                f"w{at + 1} AS MATERIALIZED (SELECT w.* REPLACE (weight * goal / sum(weight) OVER (PARTITION BY w.{d}) AS weight) "
                f"FROM w{at} w JOIN g_{d} g ON w.{d} IS NOT DISTINCT FROM g.{d})"
            )
            at += 1
    same = " AND ".join(f"r.{d} IS NOT DISTINCT FROM w.{d}" for d in dims)
    return f"""
    WITH {", ".join(steps)},
    f AS (SELECT {", ".join(dims)}, weight / tokens / (SELECT max(weight / tokens) FROM w{at}) AS rate FROM w{at})
    SELECT doc_id, r.source, r.lang, r.topic, r.tokens, round(rate, 6) AS rate
    FROM r JOIN f w ON {same}
    WHERE CAST('0x' || md5('9:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:12] AS BIGINT) / 281474976710656.0 < rate"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_sharding, op3_decontamination, op4_toxicity, op5_token_files,
        op6_suffix_dedup, op7_html_text, op8_near_text, op9_mixing, op10_near_vectors,
        op11_licenses, op12_divergence, op13_vector_codes,
    )
}
SQL: dict[str, str] = {
    "op3_decontamination": _overlaps_sql(), "op9_mixing": _mixed_sql(), "op11_licenses": sql.licenses_sql(), "op12_divergence": sql.audit_sql(),
    "op13_vector_codes": sql.codes_sql(),
}
