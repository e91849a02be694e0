"""Reproducible pseudo-random draws from hashes, independent of partitioning and retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary"))


def _word(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def hash_index(n: Column, *parts: Column | str | int) -> Column:
    """An index in ``0 .. n-1``."""
    return F.pmod(_word(_digest(*parts), 1), n)


def normal(*parts: Column | str | int) -> Column:
    """A standard normal draw (Box-Muller on the two leading words of the hash)."""
    d = _digest(*parts)
    u1 = (_word(d, 1) + 1) / F.lit(4294967297.0)
    u2 = _word(d, 9) / F.lit(4294967296.0)
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
