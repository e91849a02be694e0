"""Collapsing sub-wallet names to the root entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that end the root part of a wallet name.
DESCRIPTOR_WORDS = [
    "hot", "cold", "wallet", "internal", "multisig", "deposit", "treasury", "custodian",
    "custodial", "tether", "stablecoin", "proof", "of", "assets", "prime", "master",
    "masterwallet", "reserve", "deployer", "1", "2",
]


def root_entity(name: Column) -> Column:
    """Words before the first number or descriptor; the whole name if nothing is left."""
    words = F.split(F.trim(name), r"\s+")
    stop_word = rf"^(?:\d+|{'|'.join(DESCRIPTOR_WORDS)})$"
    flags = F.transform(words, lambda w: F.lower(w).rlike(stop_word))
    stop = F.array_position(flags, True).cast("int")  # 1-based, 0 when absent
    kept = F.slice(words, 1, F.when(stop > 0, stop - 1).otherwise(F.size(words)))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), name)
