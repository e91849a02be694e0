"""Shaping of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6, **override: int) -> DataFrame:
    """Round every double column for comparison."""
    cols: list[Column] = []
    for name, kind in df.dtypes:
        if kind == "double":
            # adding zero turns a rounded -0.0 into 0.0
            cols.append((F.round(F.col(name), override.get(name, digits)) + F.lit(0.0)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)
