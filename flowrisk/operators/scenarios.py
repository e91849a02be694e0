"""Interventional and counterfactual queries as scenario tables.

A system row holds one fitted system over the event window: its entities ``keys``, the non-zero weights (``w_dst``,
``w_src``, ``w_val``), ``drive`` (steps x entities: intercept plus the observed flow terms, which no scenario changes) and levels.
Scenarios are not rows: a part row names a range of them (sources, coalitions), and the task builds what they force. A
task gets the system of a part once, then the shock paths one after the other, so neither system nor forced paths are
repeated per draw and no scenario's path leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.functions.draws import hash_index, normal
from flowrisk.functions.linalg import System, quantile
from flowrisk.functions.tails import spearman
from flowrisk.functions.time import at, between
from flowrisk.operators.joins import bounded, keys_array
from flowrisk.operators.structural import dot
from flowrisk.session import write_table

#: Losses (numbers) that a part may hold until its quantiles are taken.
HELD = 1 << 22
_SYSTEM = ["model", "keys", "w_dst", "w_src", "w_val", "drive", "init", "hi", "pre"]


def _ordered(value: str, *order: str) -> Column:
    """Values of a group as one array in the given order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value])


def entity_levels(panel: DataFrame, fit_end: str, event_start: str, q: float = 0.95) -> DataFrame:
    """(key, init, hi, pre): value before the event, q-quantile over all time, median of the fit window."""
    before, fit = F.col("ts") < at(event_start), F.col("ts") < at(fit_end)
    return panel.groupBy("key").agg(
        F.max_by(F.when(before, F.col("value")), F.when(before, F.col("ts"))).alias("init"),
        F.percentile("value", F.lit(q)).alias("hi"),
        F.percentile(F.when(fit, F.col("value")), F.lit(0.5)).alias("pre"),
    )


def systems(rows: DataFrame, coef: DataFrame, levels: DataFrame) -> DataFrame:
    """One row per model: (model, keys[], w_dst[], w_src[], w_val[], drive[], init[], hi[], pre[]).

    ``rows`` are the design rows of the event window. Weights are kept where there is an edge; parallel edges add up.
    """
    levels = write_table(levels, "levels")
    lv = levels.agg(*[_ordered(c, "key").alias(c) for c in ("init", "hi", "pre")], F.array_sort(F.collect_list("key")).alias("keys"))
    lv = write_table(lv, "level-arrays")
    number = lv.select(F.posexplode("keys").alias("at", "key"))
    of = lambda side: number.select(F.col("key").alias(side), F.col("at").alias(f"at_{side}"))
    edges = coef.select("model", "child", F.inline(F.arrays_zip(F.col("parents").alias("parent"), F.col("w_stress").alias("weight"))))
    edges = edges.join(of("child"), "child").join(of("parent"), "parent").groupBy("model", "at_child", "at_parent").agg(F.sum("weight").alias("weight"))
    edges = edges.where("weight <> 0").groupBy("model").agg(F.array_sort(F.collect_list(F.struct("at_child", "at_parent", "weight"))).alias("e"))
    part = lambda c: F.transform("e", lambda x: x[c])
    w = edges.select("model", part("at_child").alias("w_dst"), part("at_parent").alias("w_src"), part("weight").alias("w_val"))
    k = F.size("parents")
    drive_rows = rows.select("model", "child", "ts", F.slice("xs", k + 1, k).alias("fx")).join(
        bounded(coef.select("model", "child", "b", "w_flow")), ["model", "child"]
    ).select("model", "ts", "child", (F.col("b") + dot(F.col("w_flow"), F.col("fx"))).alias("d"))
    drive = drive_rows.groupBy("model").agg(_ordered("d", "ts", "child").alias("drive"))
    out = drive.join(w, "model", "left").join(F.broadcast(lv))  # one row
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    out = out.select("model", "keys", none("w_dst", "int"), none("w_src", "int"), none("w_val", "double"), "drive", "init", "hi", "pre")
    return write_table(out, "systems")


def _sparse(systems: DataFrame) -> DataFrame:
    """``systems`` as they come from there; of rows with a whole matrix ``w`` instead, the non-zero weights."""
    if "w" not in systems.columns:
        return systems.select(*_SYSTEM)
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i) != 0)
    n = F.size("init")
    return systems.withColumn("at", at).withColumns({
        "w_dst": F.transform("at", lambda i: (i / n).cast("int")), "w_src": F.transform("at", lambda i: i % n),
        "w_val": F.transform("at", lambda i: F.get("w", i)),
    }).select(*_SYSTEM)


def _parts(systems: DataFrame, items: Column, width: Column) -> DataFrame:
    """(model, part, first, end): ranges of ``items`` scenarios per model, as many as keep all cores busy, and more where ``width`` numbers per item ask for it."""
    cores = systems.sparkSession.sparkContext.defaultParallelism
    per_model = -(-cores // max(1, systems.count()))
    step = F.greatest(F.lit(1), F.least(F.ceil(items / per_model), F.floor(HELD / width))).cast("int")
    rows = systems.select("model", items.cast("int").alias("items"), step.alias("step"))
    rows = rows.where("items > 0").select("model", "items", "step", F.explode(F.sequence(F.lit(0), F.col("items") - 1, F.col("step"))).alias("first"))
    return rows.select("model", F.col("first").alias("part"), "first", F.least(F.col("first") + F.col("step"), "items").alias("end"))


def _run(systems: DataFrame, parts: DataFrame, draws: DataFrame, runner: Callable, schema: str) -> DataFrame:
    """Rows that ``runner`` gives for every part; ``draws`` has (model, block, shocks).

    A part's system comes first and its shock paths follow one by one, in the order of ``block``.
    """
    head = parts.join(systems, "model").withColumn("block", F.lit(-1).cast("long"))
    shocks = parts.select("model", "part").join(draws.select("model", F.col("block").cast("long").alias("block"), "shocks"), "model")
    work = head.unionByName(shocks, allowMissingColumns=True)
    work = work.repartition(2 * systems.sparkSession.sparkContext.defaultParallelism, "model", "part").sortWithinPartitions("model", "part", "block")

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.block < 0:
                    if current is not None:
                        yield current.finish()
                    current = runner(r)
                else:
                    current.add(r.shocks)
        if current is not None:
            yield current.finish()

    return work.mapInPandas(streamed, schema)


class _Levels:
    """Two scenarios per source: held at 0 and at its high level; per source and target the q-quantile of the losses over all shock paths."""

    def __init__(self, r, q: float) -> None:
        self.model, self.source, self.q, self.system = r.model, np.arange(int(r.first), int(r.end)), q, System(r)
        k = len(self.source)
        self.forced = (np.arange(2 * k), np.repeat(self.source, 2), np.column_stack([np.zeros(k), np.asarray(r.hi)[self.source]]).ravel(), np.full(2 * k, -1))
        self.runs: list[np.ndarray] = []

    def add(self, shocks) -> None:
        self.runs.append(self.system.losses(2 * len(self.source), *self.forced, None, shocks))

    def finish(self) -> pd.DataFrame:
        out = quantile(np.stack(self.runs), self.q) if self.runs else np.full((2 * len(self.source), self.system.n), np.nan)
        return pd.DataFrame({"model": self.model, "i": self.source, "low": list(out[::2]), "high": list(out[1::2])})


class _Replays:
    """Two scenarios per source: on its observed path, and at its earlier level throughout."""

    def __init__(self, r) -> None:
        self.model, self.source, self.system = r.model, np.asarray(r.who, int), System(r)
        k = len(self.source)
        self.paths = np.stack([np.asarray(p, float) for p in r.paths])
        level = np.repeat(np.asarray(r.pre, float)[self.source], 2)
        self.forced = (np.arange(2 * k), np.repeat(self.source, 2), level, np.column_stack([np.arange(k), np.full(k, -1)]).ravel())
        self.loss = np.zeros((2 * k, self.system.n))

    def add(self, shocks) -> None:
        self.loss = self.system.losses(len(self.loss), *self.forced, self.paths, shocks)

    def finish(self) -> pd.DataFrame:
        return pd.DataFrame({"model": self.model, "i": self.source, "low": list(self.loss[1::2]), "high": list(self.loss[::2])})


class _Coalitions:
    """One scenario per set of players: those on their observed paths, all other entities but the target at their earlier level."""

    def __init__(self, r) -> None:
        self.model, self.target, self.system = r.model, int(r.target), System(r)
        self.coalition = np.arange(int(r.first), int(r.end))
        others = np.array([i for i in range(self.system.n) if i != self.target], int)
        player = {int(i): b for b, i in enumerate(r.who)}
        bit = np.array([player.get(i, -1) for i in others], int)
        self.paths = np.stack([np.asarray(p, float) for p in r.paths]) if len(r.paths) else None
        m = len(self.coalition)
        path = np.where((bit >= 0) & ((self.coalition[:, None] >> np.maximum(bit, 0)) & 1 == 1), bit, -1)
        self.forced = (np.repeat(np.arange(m), len(others)), np.tile(others, m), np.tile(np.asarray(r.pre, float)[others], m), path.ravel())
        self.loss = np.zeros(m)

    def add(self, shocks) -> None:
        self.loss = self.system.losses(len(self.coalition), *self.forced, self.paths, shocks)[:, self.target]

    def finish(self) -> pd.DataFrame:
        return pd.DataFrame({"model": self.model, "coalition": self.coalition, "loss": self.loss})


_PER_SOURCE = "model string, i int, low array<double>, high array<double>"


def _targets(runs: DataFrame, systems: DataFrame) -> DataFrame:
    """(model, source, target, low, high) of all pairs of different entities."""
    rows = runs.join(systems.select("model", "keys"), "model")
    rows = rows.select("model", F.get("keys", F.col("i")).alias("source"), F.inline(F.arrays_zip(F.col("keys").alias("target"), F.col("low"), F.col("high"))))
    return rows.where("source <> target")


def residual_draws(pool: DataFrame, steps: int | Column, draws: int, seed: int, joint: bool = False) -> DataFrame:
    """(model, block, shocks[]): bootstrap paths of the residuals ``pool(model, child, pos, u)``.

    Each draw is a hash of (seed, entity, draw, step), so lost tasks redo the same path and
    both force levels of a source see the same shocks. With ``joint`` all entities share the index.
    """
    size = pool.groupBy("model", "child").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    n_steps = steps if isinstance(steps, Column) else F.lit(steps)
    who = F.lit("all") if joint else F.col("child")
    spec = bounded(size).select(
        "model", "child", "first", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("block")
    ).select("*", F.explode(F.sequence(F.lit(1), n_steps)).alias("step"))
    spec = spec.withColumn("pos", F.col("first") + hash_index(F.col("n"), seed, who, F.col("block"), F.col("step")))
    return (
        spec.join(pool.select("model", "child", "pos", "u"), ["model", "child", "pos"])
        .groupBy("model", "block")
        .agg(_ordered("u", "step", "child").alias("shocks"))
        .withColumn("block", F.col("block").cast("long"))
    )


def tail_losses(systems: DataFrame, shocks: DataFrame, q: float = 0.95) -> DataFrame:
    """(model, source, target, tail_hi, tail_lo, delta): q-quantile losses under both force levels.

    Every path is run once and yields the losses of all targets; quantiles are taken where the paths of a source were run.
    """
    systems, shocks = _sparse(systems), write_table(shocks, "shocks")
    draws = shocks.groupBy("model").count().agg(F.max("count")).first()[0] or 1
    n = F.size("init")
    parts = _parts(systems, n, 2 * draws * n)
    runs = _run(systems, parts, shocks, lambda r: _Levels(r, q), _PER_SOURCE)
    out = _targets(runs, systems).withColumnsRenamed({"high": "tail_hi", "low": "tail_lo"})
    return out.select("model", "source", "target", "tail_hi", "tail_lo", (F.col("tail_hi") - F.col("tail_lo")).alias("delta"))


def exported_risk(deltas: DataFrame) -> DataFrame:
    """(model, entity, exported_risk): positive tail-loss changes summed over the targets."""
    return deltas.groupBy("model", F.col("source").alias("entity")).agg(
        F.sum(F.greatest("delta", F.lit(0.0))).alias("exported_risk")
    )


def deterministic_deltas(systems: DataFrame) -> DataFrame:
    """Like ``tail_losses`` with all shocks zero: one path per model."""
    return tail_losses(systems, systems.select("model", F.lit(0).alias("block"), F.lit(None).cast("array<double>").alias("shocks")))


def observed_window(pred: DataFrame, panel: DataFrame, start: str, end: str, abduction: str = "observed",
                    fit_end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Observed paths (key, path[]) and recovered shocks (model, shocks[]) of a window.

    ``abduction='observed'`` takes the residuals of the window itself; ``'fit_window'`` only
    knows residuals of the fit window and sets the others to zero.
    """
    inside = between(F.col("ts"), start, end, closed=True)
    paths = panel.where(inside).groupBy("key").agg(_ordered("value", "ts").alias("path"))
    u = F.col("u")
    if abduction == "fit_window":
        u = F.when(F.col("ts") < at(fit_end), u).otherwise(0.0)
    shocks = pred.where(inside).withColumn("uu", u).groupBy("model").agg(_ordered("uu", "ts", "child").alias("shocks"))
    return paths, shocks


def attribution(systems: DataFrame, paths: DataFrame, shocks: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(model, source, target, loss_replay, loss_counterfactual, attribution, share).

    Per source two scenarios: its observed path, and its pre-crisis level throughout.
    """
    systems = _sparse(systems)
    src = systems.select("model", F.posexplode("keys").alias("i", "key"))
    if sources is not None:
        src = src.where(F.col("key").isin(sources))
    src = src.join(paths, "key")
    ranges = _parts(systems, F.size("keys"), F.size("drive"))
    part = ranges.select("model", "part", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("i"))
    parts = src.join(part, ["model", "i"]).groupBy("model", "part").agg(F.array_sort(F.collect_list(F.struct("i", "path"))).alias("s"))
    parts = parts.select("model", "part", F.transform("s", lambda x: x["i"]).alias("who"), F.transform("s", lambda x: x["path"]).alias("paths"))
    runs = _run(systems, parts, shocks.withColumn("block", F.lit(0)), _Replays, _PER_SOURCE)
    diff = F.col("high") - F.col("low")
    return _targets(runs, systems).select(
        "model", "source", "target", F.col("high").alias("loss_replay"), F.col("low").alias("loss_counterfactual"), diff.alias("attribution"),
        F.when(F.col("high") > 1e-9, diff / F.col("high")).otherwise(0.0).alias("share"),
    )


def coalition_losses(systems: DataFrame, paths: DataFrame, shocks: DataFrame, target: str, players: list[str]) -> DataFrame:
    """(model, coalition, loss): loss of the target with the players in the coalition (a bit set)
    on their observed paths and every other entity but the target at its pre-crisis level."""
    systems = _sparse(systems)
    order = F.array(*map(F.lit, players))
    known = paths.where(F.col("key").isin(players)).agg(F.map_from_entries(F.collect_list(F.struct("key", "path"))).alias("path_of"))
    place = lambda name: (F.array_position("keys", name) - 1).cast("int")
    extra = systems.join(F.broadcast(known)).select(  # one row of the players' paths
        "model", place(F.lit(target)).alias("target"), F.transform(order, place).alias("who"), F.transform(order, lambda p: F.try_element_at("path_of", p)).alias("paths")
    )
    parts = _parts(systems, F.lit(2 ** len(players)), F.size("drive")).join(extra, "model")
    return _run(systems, parts, shocks.withColumn("block", F.lit(0)), _Coalitions, "model string, coalition long, loss double")


def shapley(losses: DataFrame, players: list[str]) -> DataFrame:
    """(model, player, shapley, total_effect) from the coalition losses."""
    k = len(players)
    fact = [1]
    for i in range(1, k + 1):
        fact.append(fact[-1] * i)
    # weight of a coalition of size s that the player joins
    weight = F.array(*[F.lit(fact[s] * fact[k - s - 1] / fact[k]) for s in range(k)])
    who = F.inline(F.array(*[F.struct(F.lit(p).alias("player"), F.lit(2**b).alias("bit")) for b, p in enumerate(players)]))
    without = losses.select("*", who).where(F.col("coalition").bitwiseAND(F.col("bit")) == 0)
    joined = losses.select("model", F.col("coalition").alias("with_player"), F.col("loss").alias("loss_with"))
    pairs = without.withColumn("with_player", F.col("coalition") + F.col("bit")).join(joined, ["model", "with_player"])
    gain = F.get(weight, F.bit_count("coalition").cast("int")) * (F.col("loss_with") - F.col("loss"))
    total = losses.groupBy("model").agg(
        (F.max_by("loss", "coalition") - F.min_by("loss", "coalition")).alias("total_effect")
    )
    return pairs.groupBy("model", "player").agg(F.sum(gain).alias("shapley")).join(total, "model")


def perturbed(coef: DataFrame, count: int, sd: float, seed: int, flows_too: bool) -> DataFrame:
    """``count`` copies of one model's coefficients, each weight times 1 + N(0, sd); model = copy number."""
    p = coef.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("copy"))

    def noisy(kind: str, col: str) -> Column:
        factor = lambda i: 1 + F.lit(sd) * normal(seed, kind, F.col("copy"), F.col("child"), i)
        return F.transform(col, lambda w, i: w * factor(i))

    return p.select(
        F.format_string("copy-%03d", "copy").alias("model"), "child", "parents",
        noisy("stress", "w_stress").alias("w_stress"),
        (noisy("flow", "w_flow") if flows_too else F.col("w_flow")).alias("w_flow"), "b", "n",
    )


def for_models(df: DataFrame, models: DataFrame) -> DataFrame:
    """Repeat the rows of one model under each name of ``models(model)``, a bounded list."""
    names = keys_array(models, "model")
    return df.drop("model").select(F.explode(names).alias("model"), "*")


def compare_rankings(base: DataFrame, other: DataFrame, value: str = "exported_risk", key: str = "entity") -> DataFrame:
    """Per model of ``other``: rank correlation with ``base`` over common entities and top-3 overlap."""
    from pyspark.sql import Window as W

    def top(df: DataFrame, *by: str) -> Column:
        return F.row_number().over(W.partitionBy(*by).orderBy(F.desc(value), key)) <= 3

    b = base.select(F.col(key), F.col(value).alias("base_v"), top(base).cast("int").alias("base_top"))
    o = other.select("model", key, F.col(value).alias("other_v"), top(other, "model").cast("int").alias("other_top"))
    both = o.join(bounded(b), key)
    rho = spearman(both, "base_v", "other_v", "model")
    overlap = both.groupBy("model").agg((F.sum(F.col("base_top") * F.col("other_top")) / 3.0).alias("top3_overlap"))
    return rho.join(overlap, "model").select("model", "rho", "n", "top3_overlap")
