"""Integer product quantisation of vectors: distances are gathered from tables over the distinct integers of each dimension."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowrisk.session import write_table

#: Vectors of one block. A block has at most so many distinct integers in a dimension, which bounds its tables.
BLOCK = 2048


@dataclass(frozen=True)
class Settings:
    """``parts`` equal pieces with ``entries`` code words each (at most 256), ``rounds`` rounds of assignment and mean; integers are floor(scale * x)."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


DEFAULT = Settings()


def dictionaries(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct integers of each dimension (column) of ``x`` and each value's place among them."""
    values, codes = [], np.empty(x.shape[::-1], np.uint16)
    for d in range(x.shape[1]):
        distinct, codes[d] = np.unique(x[:, d], return_inverse=True)
        values.append(distinct)
    return values, codes


def distances(values: list[np.ndarray], codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of every vector to every entry of ``book`` (entries x dimensions).

    Per dimension the squared differences of all distinct integers to all entries are tabulated; a vector's
    distance is the sum of the table rows that its codes point to. 32-bit sums are used where none can overflow.
    """
    reach = max([int(max(v[-1], b.max())) - int(min(v[0], b.min())) for v, b in zip(values, book.T, strict=True)], default=0)
    kind = np.int32 if reach * reach * len(values) < 1 << 31 else np.int64
    out = np.zeros((codes.shape[1], len(book)), kind)
    for v, c, b in zip(values, codes, book.T, strict=True):
        difference = v[:, None] - b[None, :]
        out += (difference * difference).astype(kind)[c]
    return out


def nearest(values: list[np.ndarray], codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per part (row) the nearest entry of each vector, the lower index on ties, and its squared distance."""
    width = books.shape[2]
    entry, distance = np.empty((len(books), codes.shape[1]), np.int64), np.empty((len(books), codes.shape[1]), np.int64)
    for p, book in enumerate(books):
        own = slice(p * width, (p + 1) * width)
        d = distances(values[own], codes[own], book)
        entry[p] = d.argmin(axis=1)
        distance[p] = d[np.arange(len(d)), entry[p]]
    return entry, distance


def _blocks(kept: DataFrame) -> DataFrame:
    """One row per block: ids, labels, the integers' dictionaries and the codes of all vectors, dimension by dimension."""
    label = kept.schema["label"].dataType
    schema = T.StructType([
        T.StructField("vec_id", T.ArrayType(T.LongType())), T.StructField("label", T.ArrayType(label)),
        T.StructField("values", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("codes", T.BinaryType()),
    ])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                n = batch.num_rows
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                values, codes = dictionaries(x)
                ends = np.cumsum([0, *map(len, values)])
                inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
                one = pa.array([0, n], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(one, batch.column(0)), pa.ListArray.from_arrays(one, batch.column(1)),
                    pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), inner), pa.array([codes.tobytes()], pa.binary()),
                ], names=["vec_id", "label", "values", "codes"])

    return kept.select("vec_id", "label", "x").mapInArrow(packed, schema)


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[list[np.ndarray], np.ndarray]:
    values = [np.asarray(v, np.int64) for v in batch.column(batch.schema.get_field_index("values"))[i].as_py()]
    raw = batch.column(batch.schema.get_field_index("codes"))[i].as_buffer()
    return values, np.frombuffer(raw, np.uint16).reshape(len(values), -1)


def _means(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: every entry becomes the floored mean of its parts; an entry without parts stays."""
    parts, entries, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                values, codes = _unpacked(batch, i)
                entry, _ = nearest(values, codes, books)
                for p in range(parts):
                    count[p] += np.bincount(entry[p], minlength=entries)
                    for j in range(width):
                        d = p * width + j
                        np.add.at(total[p, :, j], entry[p], values[d][codes[d]])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": p, "entry": e, "n": count[p, e], "total": list(total[p, e])})

    partial = blocks.select("values", "codes").mapInArrow(summed, "part long, entry long, n long, total array<long>")
    sums = [F.sum(F.get("total", F.lit(j))) for j in range(width)]
    rows = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*sums).alias("total")).collect()  # parts x entries at most
    out = books.copy()
    for r in rows:
        out[r["part"], r["entry"]] = [t // r["n"] for t in r["total"]]
    return out


def _first_books(kept: DataFrame, how: Settings) -> np.ndarray:
    """Codebooks of the vectors of smallest ids, parts x entries x width; fewer entries where there are fewer vectors."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(how.entries).select("x").collect()
    x = np.array([r["x"] for r in rows], np.int64)
    return x.reshape(len(rows), how.parts, -1).transpose(1, 0, 2)


def integers(vectors: DataFrame, how: Settings = DEFAULT) -> DataFrame:
    """vec_id, label and ``x``, the integer components of the rows whose vector is not null and has no null or non-finite component; written."""
    parts = F.col("embedding")
    finite = F.forall(parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    kept = vectors.filter(F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(parts, lambda x: F.floor(x.cast("double") * how.scale)).alias("x")
    )
    return write_table(kept, "vector-integers")


def _common_size(kept: DataFrame, how: Settings) -> int:
    """The size that most vectors have (the larger one on ties), 0 if it cannot be cut into parts; raises if squared distances could leave 64 bits."""
    sizes = kept.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("reach"))
    r = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if r is None or r["size"] % how.parts or not r["size"]:
        return 0
    if 4 * r["reach"] * r["reach"] * r["size"] >= 1 << 63:
        raise ValueError("components are too large for squared distances of 64 bits")
    return r["size"]


def compressed(vectors: DataFrame, how: Settings = DEFAULT) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` for every usable row of ``vectors``.

    Codebooks start as the parts of the ``how.entries`` vectors of smallest ``vec_id`` (null ids last, equal ids by their vectors; fewer
    entries where there are fewer vectors) and take ``how.rounds`` rounds: assign every part to its nearest entry, the lower index on ties, and
    replace each entry by its parts' floored mean. ``code`` has two hex digits per part, ``error`` the squared distance, ``label_error``
    the sum of errors over rows of equal label (nulls together), and the last column the digest of all final entries.

    A block of ``BLOCK`` vectors keeps its distinct integers per dimension and codes into them, written once; every round tabulates,
    gathers and adds. Only codebooks pass through the driver. Repeated rows each get a row. Rows whose vector is null or has a null or non-finite component
    are left out. Vectors of another size than most have, and all if that size is no multiple of ``how.parts``, keep their row with null code and error.
    Components so large that a squared distance could leave 64 bits are an error; an empty table gives an empty result. Only vec_id, embedding and label are read, so other columns cannot clash.
    """
    whole = integers(vectors, how)
    size = _common_size(whole, how)
    kept, others = whole.filter(F.size("x") == (size or -1)), whole.filter(F.size("x") != (size or -1))
    books = _first_books(kept, how) if size else np.zeros((how.parts, 0, 0), np.int64)
    blocks = write_table(_blocks(kept), "vector-blocks")
    for _ in range(how.rounds if size else 0):
        books = _means(blocks, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    label = kept.schema["label"].dataType
    schema = T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
    ])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entry, distance = nearest(*_unpacked(batch, i), books)
                code = [row.tobytes().hex() for row in entry.T.astype(np.uint8)]
                one = batch.slice(i, 1)
                ids, labels = one.column(0).flatten(), one.column(1).flatten()
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(distance.sum(axis=0))], names=["vec_id", "label", "code", "error"])

    plain = others.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = write_table(blocks.mapInArrow(coded, schema).unionByName(plain), "vector-codes")
    sums = write_table(out.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    joined = out.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
