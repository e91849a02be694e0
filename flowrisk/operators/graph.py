"""The flow graph as an edge table (model, src, dst, usd, n_tx, confidence, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.operators.joins import bounded, sized
from flowrisk.operators.resolve import RESIDUAL, endpoints
from flowrisk.session import write_table

OBSERVED, DOCUMENTED = "observed_flow", "documented"
# Rounds of reachability read apart before they are gathered in one table.
ROUNDS_HELD = 16


def edge_totals(flows: DataFrame) -> DataFrame:
    """Flow totals over all time."""
    return flows.groupBy("src", "dst").agg(F.sum("usd").alias("usd"), F.sum("n_tx").alias("n_tx"))


def median_edge_volume(flows: DataFrame) -> Column:
    """Median of the edge totals, as a scale-free edge threshold."""
    return edge_totals(flows).agg(F.percentile("usd", F.lit(0.5))).scalar()


def build_graph(flows: DataFrame, min_usd: float | Column = 1e6, documented: DataFrame | None = None) -> DataFrame:
    """Edges whose total volume reaches ``min_usd``, plus documented edges not among them."""
    totals = edge_totals(flows)
    floor = min_usd if isinstance(min_usd, Column) else F.lit(float(min_usd))
    touches_residual = (F.col("src") == RESIDUAL) | (F.col("dst") == RESIDUAL)
    observed = totals.where((F.col("src") != F.col("dst")) & (F.col("usd") >= floor)).select(
        "src", "dst", "usd", "n_tx",
        F.when(touches_residual, 0.5).otherwise(1.0).alias("confidence"),
        F.lit(OBSERVED).alias("source"),
    )
    if documented is None:
        return observed
    prior = documented.where("src <> dst").distinct()
    # One pass: the documented pairs left over are those whose total misses the floor.
    missing = (
        prior.join(totals, ["src", "dst"], "left")
        .where(F.col("usd").isNull() | (F.col("usd") < floor))
        .select(
            "src", "dst", F.coalesce("usd", F.lit(0.0)).alias("usd"), F.lit(0).cast("long").alias("n_tx"),
            F.lit(0.7).alias("confidence"), F.lit(DOCUMENTED).alias("source"),
        )
    )
    return observed.unionByName(missing)


def graph_nodes(flows: DataFrame, documented: DataFrame | None = None) -> DataFrame:
    """(entity): endpoints of the flows and of the documented edges."""
    nodes = endpoints(flows).select("entity")
    if documented is not None:
        nodes = nodes.union(documented.select(F.explode(F.array("src", "dst"))))
    return nodes.distinct()


def parents(edges: DataFrame) -> DataFrame:
    """(child, parents[]) with multiplicity, in name order."""
    return edges.groupBy(F.col("dst").alias("child")).agg(F.array_sort(F.collect_list("src")).alias("parents"))


def reverse(edges: DataFrame) -> DataFrame:
    turned = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return edges.select(*[turned.get(c, F.col(c)) for c in edges.columns])


def symmetric(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) in both orientations."""
    e = edges.select("src", "dst")
    return e.union(e.select("dst", "src")).distinct()


def reverse_where(edges: DataFrame, cond: Column) -> DataFrame:
    """Turn around the edges matching ``cond``; a pair may then occur twice."""
    return edges.withColumns(
        {"src": F.when(cond, F.col("dst")).otherwise(F.col("src")),
         "dst": F.when(cond, F.col("src")).otherwise(F.col("dst"))}
    )


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (or flows) with both ends in ``nodes(entity)``."""
    out = edges
    for side in ("src", "dst"):
        out = out.join(nodes.select(F.col("entity").alias(side)), side, "left_semi")
    return out.select(*edges.columns)


def without_node(edges: DataFrame, node: str = RESIDUAL) -> DataFrame:
    return edges.where((F.col("src") != node) & (F.col("dst") != node))


def without_edges(edges: DataFrame, drop: DataFrame) -> DataFrame:
    """Edges not listed in ``drop(src, dst)``."""
    return edges.join(drop.select("src", "dst"), ["src", "dst"], "left_anti").select(*edges.columns)


def graph_size(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_observed, n_documented."""
    e = edges.agg(
        F.count("*").alias("n_edges"),
        F.count_if(F.col("source") == OBSERVED).alias("n_observed"),
        F.count_if(F.col("source") == DOCUMENTED).alias("n_documented"),
    )
    return e.select(nodes.agg(F.count("*")).scalar().alias("n_nodes"), "*")


def reachability(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a directed path of at least one edge.

    Each round extends only the pairs found by the last one, by an edge, and keeps those not known yet;
    a diameter of d takes d rounds. Rounds are written, and gathered in one table every ``ROUNDS_HELD``
    rounds so that the plan stays short.
    """
    steps = write_table(edges.select("src", "dst").distinct(), "reach")
    after = steps.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
    known = new = steps
    held = 0
    while not new.isEmpty():
        longer = new.join(after, "dst").select("src", F.col("end").alias("dst")).distinct()
        new = write_table(longer.join(known, ["src", "dst"], "left_anti"), "reach")
        known, held = known.unionByName(new), held + 1
        if held == ROUNDS_HELD:
            known, held = write_table(known, "reach"), 0
    return known


def log_weights(edges: DataFrame, weight: str = "volume") -> DataFrame:
    """(src, dst, w): log1p weights."""
    return edges.select("src", "dst", F.log1p(F.coalesce(F.col(weight), F.lit(0.0))).alias("w"))


def degree_scales(weighted: DataFrame, tiny: float = 1e-9) -> DataFrame:
    """(node, d): one over the root of the weights at a node, both orientations counted."""
    ends = weighted.select(F.explode(F.array("src", "dst")).alias("node"), "w")
    return ends.groupBy("node").agg((1 / F.sqrt(F.sum("w") + tiny)).alias("d"))


def normalized_adjacency(edges: DataFrame, weight: str = "volume", tiny: float = 1e-9) -> DataFrame:
    """Symmetric normalised adjacency (i, j, w): log1p weights, both orientations added.

    Both directions of a pair are added up while it is one row, and only then turned into both orientations, so the sum
    shuffles each edge once; ``edges`` is read twice and should be a stage.
    """
    e = log_weights(edges, weight)
    degree = sized(degree_scales(e, tiny))
    ends = {"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}
    known = e.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    pairs = known.select(*[c.alias(n) for n, c in ends.items()], "w").groupBy("a", "b").agg(F.sum("w").alias("w"))
    for side in ("a", "b"):
        pairs = pairs.join(degree.select(F.col("node").alias(side), F.col("d").alias(f"d_{side}")), side)
    w = F.col("w") * F.col("d_a") * F.col("d_b")
    loop = F.col("a") == F.col("b")
    turn = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.when(loop, 2 * w).otherwise(w).alias("w"))
    return pairs.select(F.inline(F.when(loop, F.array(turn("a", "b"))).otherwise(F.array(turn("a", "b"), turn("b", "a")))))


def volume_coverage(flows: DataFrame, edges_nodes: DataFrame) -> DataFrame:
    """Share of volume with both, or at least one, named endpoint."""
    named_both = (F.col("src") != RESIDUAL) & (F.col("dst") != RESIDUAL)
    named_any = (F.col("src") != RESIDUAL) | (F.col("dst") != RESIDUAL)
    usd = F.col("usd")
    return flows.agg(
        F.sum("usd").alias("total_usd"),
        F.try_divide(F.sum(F.when(named_both, usd).otherwise(0.0)), F.sum("usd")).alias("named_both_sides"),
        F.try_divide(F.sum(F.when(named_any, usd).otherwise(0.0)), F.sum("usd")).alias("touching_named"),
    ).withColumn("n_named_entities", edges_nodes.where(F.col("entity") != RESIDUAL).agg(F.count("*")).scalar())


def mapped_returns(returns: DataFrame, entity_assets: DataFrame) -> DataFrame:
    """(ts, key, value) per entity from the returns of its asset, complete cases only."""
    from flowrisk.operators.series import complete_cases

    m = entity_assets.select("entity", F.col("asset").alias("key"))
    panel = returns.join(bounded(m), "key").select("ts", F.col("entity").alias("key"), "value")
    return complete_cases(panel)
