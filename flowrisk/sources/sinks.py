"""Result tables: written as Parquet or JSON, and read back as inputs of later jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def load_result(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)
