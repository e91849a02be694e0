"""Small literal relations (registries) as inline tables the optimizer can fold."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_relation(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """Rows given in code as a relation; ``schema`` is DDL such as ``'src string, dst string'``."""
    struct = T._parse_datatype_string(schema)
    rows = list(rows)
    if not rows:
        return spark.createDataFrame([], struct)
    lits = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, struct.fields)])
        for r in rows
    ]
    return spark.range(1).select(F.inline(F.array(*lits)))


def explode_registry(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested registry (name, type, ref_id, addresses[]) -> (addr, name) and (name, type, ref_id)."""
    seed = entities.select(F.explode("addresses").alias("addr"), "name").select(
        F.lower("addr").alias("addr"), "name"
    )
    return seed, entities.select("name", "type", "ref_id")
