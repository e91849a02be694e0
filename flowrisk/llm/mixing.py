"""Sampling to target weights by iterative proportional fitting, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.session import write_table

#: Rounds end when all marginals are met to TOLERANCE, or after ROUNDS if the targets contradict each other.
TOLERANCE, ROUNDS = 1e-9, 60
#: With a share of tokens to keep, marginals are met to KEEP_TOLERANCE; after PASSES passes the cells are only scaled. A value
#: whose whole cells exceed its target still gets LEAST of its target for its other cells.
KEEP_TOLERANCE, PASSES, LEAST = 1e-4, 4, 0.01
#: The default target of a value is its share of tokens to this power: large values give way to small ones.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 1.0}


def tokens(text: Column) -> Column:
    """Words between white space, and one for the end of the document."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r]+"), lambda w: w != "")
    return F.size(words).cast("long") + 1


def topic(text: Column) -> Column:
    """A coarse topic by form: tables, marked-up noise, short notes, prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit(" | ")), "table").when(text.rlike(r"%%%|###|&&&"), "noise")
        .when(tokens(text) <= 50, "note").otherwise("prose")
    )


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """``dim``, ``share``: target shares proportional to the token share to ``power``."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("p"))
    total = sums.agg(F.sum("p").alias("all"))
    return sums.select(dim, (F.col("p") / F.lit(total.first()["all"])).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` with ``weight``: shares that meet the target share of every value of every dimension.

    Starting from the cells' shares of ``tokens``, each round scales the cells of every value to its
    target, one dimension after the other. A value without a target has target 0; targets of values
    without cells are spread over the others. Every step is a sum per value and a join on the value (null is a value), written
    to the shared folder; nothing is gathered.
    """
    dims = list(targets)
    total = cells.agg(F.sum("tokens").cast("double").alias("t")).first()["t"]
    if total is None:
        return cells.withColumn("weight", F.lit(0.0))
    goals = {}
    for d in dims:
        present = targets[d].join(cells.select(F.col(d).alias("__v")).distinct(), F.col(d).eqNullSafe(F.col("__v"))).drop("__v")
        present = write_table(present, "targets")
        reach = present.agg(F.sum("share")).first()[0] or 1.0
        goals[d] = present.select(F.col(d).alias("__v"), (F.col("share") / reach).alias("goal"))
    return _fitted(cells.withColumn("weight", F.col("tokens") / F.lit(total)), goals, TOLERANCE)


def _fitted(now: DataFrame, goals: dict[str, DataFrame], tolerance: float) -> DataFrame:
    """``now`` with ``weight`` scaled in rounds to the ``goal`` of every value ``__v`` of every dimension."""
    dims = list(goals)
    for _ in range(ROUNDS):
        for d in dims:
            sums = now.groupBy(F.col(d).alias("__s")).agg(F.sum("weight").alias("have"))
            factor = sums.join(goals[d], F.col("__s").eqNullSafe(F.col("__v")), "left")
            factor = factor.select("__s", (F.coalesce("goal", F.lit(0.0)) / F.when(F.col("have") > 0, F.col("have")).otherwise(1.0)).alias("f"))
            now = now.join(factor, F.col(d).eqNullSafe(F.col("__s"))).drop("__s").withColumn("weight", F.col("weight") * F.col("f")).drop("f")
            now = write_table(now, "raked")
        gaps = [
            now.groupBy(F.col(d).alias("__s")).agg(F.sum("weight").alias("have")).join(goals[d], F.col("__s").eqNullSafe(F.col("__v")))
            .select(F.abs(F.col("have") - F.col("goal")).alias("gap"))
            for d in dims[:-1]
        ]
        if not gaps or (reduce(DataFrame.unionAll, gaps).agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            break
    return now


def rake_within(cells: DataFrame, targets: dict[str, DataFrame], keep: float) -> DataFrame:
    """``cells`` with ``weight``: the tokens to sample, in all ``keep`` of all tokens, and of no cell more than it has.

    Cells are raked to the targets, times the tokens to keep. Cells that would need more tokens than they have are kept
    whole, values of whole cells only leave the rest to the other values in proportion to their targets, and another pass rakes
    the other cells to what their values still lack, until no cell is short. So a value too rare for its
    target moves the other rates by its few tokens only. A value without a target has target 0; less than ``keep``
    is sampled only if the values with a target have fewer tokens.
    """
    wanted = keep * (cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0)
    now = cells.withColumn("weight", F.col("tokens").cast("double")).withColumn("whole", F.lit(False))
    if keep >= 1:
        return now.drop("whole")
    n_whole, passes = 0, 0
    while True:
        free, whole = now.filter("not whole"), now.filter("whole")
        left = wanted - (whole.agg(F.sum("tokens").cast("double")).first()[0] or 0.0)
        goals = {}
        for d in targets if passes < PASSES else ():
            values = now.groupBy(F.col(d).alias("__v")).agg(
                F.sum(F.when(F.col("whole"), F.col("tokens")).otherwise(0)).alias("has"), F.bool_or(~F.col("whole")).alias("open")
            )
            values = write_table(values.join(targets[d], F.col("__v").eqNullSafe(F.col(d)), "left").select("__v", "has", "open", "share"), "lacks")
            closed, reach = values.agg(F.sum(F.when(~F.col("open"), F.col("has"))).cast("double"), F.sum(F.when(F.col("open"), F.col("share")))).first()
            goal = F.lit((wanted - (closed or 0.0)) / (reach or 1.0)) * F.coalesce("share", F.lit(0.0))
            values = values.filter("open").select("__v", F.greatest(goal - F.col("has"), goal * LEAST).alias("lacks"))
            lacks = values.agg(F.sum("lacks")).first()[0] or 1.0
            goals[d] = values.select("__v", (F.col("lacks") / F.lit(lacks)).alias("goal"))
        fitted = _fitted(free, goals, KEEP_TOLERANCE) if goals else free
        total = fitted.agg(F.sum("weight")).first()[0]
        if not total or left <= 0:
            return now.withColumn("weight", F.when(F.col("whole"), F.col("weight")).otherwise(0.0)).drop("whole")
        scaled = F.col("weight") * F.lit(left / total)
        fitted = fitted.withColumn("weight", F.least(scaled, F.col("tokens"))).withColumn("whole", F.col("weight") >= F.col("tokens"))
        now = write_table(fitted.unionByName(whole), "raked-within")
        before, n_whole, passes = n_whole, now.filter("whole").count(), passes + 1
        if n_whole == before:
            return now.drop("whole")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mixed(docs: DataFrame, powers: dict[str, float] | None = None, key: str = "doc_id", seed: int = 9, targets: dict[str, DataFrame] | None = None, keep: float | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with ``topic``, ``tokens`` and ``rate``, their probability.

    Token weights of the cells (source, lang, topic) are raked to the targets (default:
    tempered token shares). A cell's rate is its weight over its share of tokens. Without ``keep`` it is scaled so that the
    largest rate is 1: no document is repeated, and the expected tokens of the sample have the target
    marginals, but the rarest value against its target decides how much is kept. With ``keep`` the expected tokens of the sample are that share of
    all tokens, cells too rare for their target are whole, and the other cells meet the targets (``rake_within``). Whether a document is drawn depends on its key and the seed, so rows that repeat a key in the same cell stay or go together.
    Null sources and languages are values of their own, null and empty texts have one token. An empty
    table gives an empty result. Columns named topic, tokens or rate are replaced.
    """
    powers = TEMPER if powers is None else powers
    dims = list(powers)
    rows = docs.drop("topic", "tokens", "rate").withColumn("topic", topic(F.col("text"))).withColumn("tokens", tokens(F.col("text")))
    cells = write_table(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    if cells.isEmpty():
        return rows.withColumn("rate", F.lit(1.0)).limit(0)
    targets = targets or {d: tempered(cells, d, p) for d, p in powers.items()}
    raked = rake(cells, targets) if keep is None else rake_within(cells, targets, keep)
    ratio = F.col("weight") / F.col("tokens")
    largest = raked.agg(F.max(ratio)).first()[0] if keep is None else 1.0
    rates = raked.select(*[F.col(d).alias(f"__{d}") for d in dims], (ratio / F.lit(largest)).alias("rate"))
    same = reduce(Column.__and__, [F.col(d).eqNullSafe(F.col(f"__{d}")) for d in dims])
    out = rows.join(rates, same).drop(*[f"__{d}" for d in dims])
    return out.filter(draw(F.col(key), seed) < F.col("rate"))
