"""Resolution, flow and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.functions.names import root_entity
from flowrisk.functions.output import rounded
from flowrisk.operators import graph as G
from flowrisk.operators import resolve as R
from flowrisk.plans.address_queries import edges as address_edges
from flowrisk.plans.inputs import Inputs
from flowrisk.plans.oracle import CTES, collapsed, compose, throughput
from flowrisk.plans.queries import query
from flowrisk.sources import tables as T
from flowrisk.sources.ingest import rejected, typed_transfers
from flowrisk.sources.registry import literal_relation

FLOW_COLS = "bucket, src, dst, round(usd, 4) AS usd, n_tx, src_prov, dst_prov"


@query("resolved_flows", compose(f"SELECT {FLOW_COLS} FROM flows"))
def _resolved(i: Inputs) -> DataFrame:
    return rounded(i.resolved("week"), 4)


@query("resolved_flows_daily", compose(f"SELECT {FLOW_COLS} FROM flows_day"))
def _resolved_daily(i: Inputs) -> DataFrame:
    return rounded(i.resolved("day"), 4)


RAW_SQL = """
SELECT l_returnflag AS token, CASE WHEN l_linenumber = 1 THEN 'n/a' WHEN l_linenumber = 2 THEN concat('1', repeat('0', 40))
  ELSE CAST(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT) AS VARCHAR) END AS value FROM lineitem"""


@query("rejected_transfers", f"""
SELECT lower(token) AS token_addr, count(*) AS n_rows, count(*) FILTER (TRY_CAST(value AS DOUBLE) IS NULL) AS n_rejected,
  sum(TRY_CAST(value AS DECIMAL(38, 0)))::DOUBLE AS total, round(sum(TRY_CAST(value AS DOUBLE)) / 1e40, 4) AS total_e40
FROM ({RAW_SQL}) GROUP BY 1""")
def _rejected(i: Inputs) -> DataFrame:
    """Line items as text rows, some of them malformed, some of 41 digits."""
    line = F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("long").cast("string")
    raw = T.read(i.spark, i.dir, "lineitem").select(
        F.col("l_shipdate").cast("string").alias("block_time"), F.col("l_returnflag").alias("token_addr"),
        F.lit("A").alias("from_addr"), F.lit("B").alias("to_addr"),
        F.when(line == 1, "n/a").when(line == 2, F.concat(F.lit("1"), F.repeat(F.lit("0"), 40))).otherwise(cents).alias("value"),
    )
    kept = typed_transfers(raw).groupBy("token_addr").agg(
        F.sum(F.when(F.col("value") < 1e38, F.col("value").cast("decimal(38,0)"))).cast("double").alias("total"),
        F.round(F.sum("value") / 1e40, 4).alias("total_e40"),
    )
    return rejected(raw).join(kept, "token_addr", "left")


@query("deduped_labels", compose("SELECT addr, name FROM label1"))
def _labels(i: Inputs) -> DataFrame:
    return R.dedupe_labels(T.address_labels(i.spark, i.dir))


@query("entity_roots", compose("SELECT addr, name, regexp_replace(name, ' (?:[0-9]+|Hot|Cold|Deposit)( .*)?$', '') AS root FROM labels_raw"))
def _roots(i: Inputs) -> DataFrame:
    return T.address_labels(i.spark, i.dir).select("addr", "name", root_entity(F.col("name")).alias("root"))


@query(
    "address_book",
    compose("""
SELECT coalesce(s.addr, l.addr) AS addr, coalesce(s.name, l.name) AS name,
  CASE WHEN s.name IS NOT NULL THEN 'seed' ELSE 'dune_cex' END AS prov, r.root, c.confidence
FROM label1 l FULL JOIN seed s ON l.addr = s.addr JOIN roots r ON r.name = coalesce(s.name, l.name)
JOIN (VALUES ('seed', 1e0), ('dune_cex', 0.9e0)) c(prov, confidence) ON c.prov = CASE WHEN s.name IS NOT NULL THEN 'seed' ELSE 'dune_cex' END"""),
)
def _book(i: Inputs) -> DataFrame:
    conf = literal_relation(i.spark, R.SOURCE_CONFIDENCE, "prov string, confidence double")
    return i.book().join(F.broadcast(conf), "prov")


@query(
    "labelled_flows_usd",
    compose("""
WITH tok AS (SELECT date_trunc('day', block_time)::TIMESTAMP AS bucket, token, coalesce(sf.name, 'retail') AS src,
    coalesce(st.name, 'retail') AS dst, sum(amount) AS volume, count(*) AS n_tx
  FROM transfers t LEFT JOIN seed sf ON t.from_addr = sf.addr LEFT JOIN seed st ON t.to_addr = st.addr
  WHERE sf.name IS NOT NULL OR st.name IS NOT NULL GROUP BY ALL),
px AS (SELECT c.bucket, p.price FROM (SELECT DISTINCT bucket FROM tok) c
  LEFT JOIN (SELECT ts, price / 100000 AS price FROM day_prices WHERE key = '1-URGENT') p ON p.ts = c.bucket),
filled AS (SELECT bucket, coalesce(last_value(price IGNORE NULLS) OVER (ORDER BY bucket),
  first_value(price IGNORE NULLS) OVER (ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS px FROM px)
SELECT t.bucket, src, dst, round(sum(volume * CASE WHEN token = 'R' THEN px ELSE 1 END), 4) AS usd, sum(n_tx)::BIGINT AS n_tx
FROM tok t JOIN filled f ON t.bucket = f.bucket GROUP BY ALL"""),
)
def _labelled_usd(i: Inputs) -> DataFrame:
    tok = R.labelled_token_flows(i.transfers(), i.tokens(), i.seed(), "day")
    price = i.prices("day").where(F.col("key") == "1-URGENT").withColumn("price", F.col("price") / 100000)
    return rounded(R.to_usd(tok, price, T.ETH_LIKE_TOKENS), 4)


@query(
    "labelled_token_flows",
    compose("""
SELECT date_trunc('week', block_time)::TIMESTAMP AS bucket, token AS sym, coalesce(sf.name, 'retail') AS src,
  coalesce(st.name, 'retail') AS dst, round(sum(amount), 4) AS volume, count(*) AS n_tx
FROM transfers t LEFT JOIN seed sf ON t.from_addr = sf.addr LEFT JOIN seed st ON t.to_addr = st.addr
WHERE sf.name IS NOT NULL OR st.name IS NOT NULL GROUP BY ALL"""),
)
def _labelled_tokens(i: Inputs) -> DataFrame:
    return rounded(R.labelled_token_flows(i.transfers(), i.tokens(), i.seed(), "week"), 4)


@query(
    "merged_flow_batches",
    compose(f"""
WITH merged AS (SELECT * FROM flows UNION ALL SELECT date_trunc('week', bucket)::TIMESTAMP, src, dst, usd, n_tx, src_prov, dst_prov FROM flows_day)
SELECT bucket, src, dst, round(sum(usd), 4) AS usd, sum(n_tx)::BIGINT AS n_tx, max(src_prov) AS src_prov, max(dst_prov) AS dst_prov
FROM merged GROUP BY bucket, src, dst"""),
)
def _merged(i: Inputs) -> DataFrame:
    daily = i.resolved("day").withColumn("bucket", F.date_trunc("week", "bucket").cast("timestamp_ntz"))
    return rounded(R.merge_batches(i.resolved("week"), daily), 4)


@query("entity_throughput", compose(f"SELECT entity, round(usd, 4) AS usd FROM ({throughput('flows')})"))
def _throughput(i: Inputs) -> DataFrame:
    return rounded(R.throughput(i.resolved()), 4)


@query("top_k_flows", compose(f"SELECT {FLOW_COLS} FROM flows_k"))
def _top_k(i: Inputs) -> DataFrame:
    return rounded(i.flows(), 4)


@query("seed_only_flows", compose(f"SELECT {FLOW_COLS} FROM flows_seed"))
def _seed_only(i: Inputs) -> DataFrame:
    return rounded(i.seed_flows(), 4)


@query(
    "entity_types",
    compose("""
SELECT e.entity, CASE WHEN e.entity = 'retail' THEN 'RETAIL' ELSE coalesce(t.type, 'CEX') END AS type
FROM (SELECT src AS entity FROM flows_k UNION SELECT dst FROM flows_k UNION SELECT name FROM seed_names UNION SELECT 'retail') e
LEFT JOIN seed_types t ON e.entity = t.name"""),
)
def _types(i: Inputs) -> DataFrame:
    return i.types()


@query(
    "deposit_sweeps",
    compose("""
WITH tr AS (SELECT from_addr, to_addr, amount * 10000 AS value FROM transfers WHERE token <> 'R' AND amount > 0),
recv AS (SELECT to_addr AS addr, sum(value) AS inflow FROM tr GROUP BY 1),
swept AS (SELECT from_addr AS addr, sum(value) AS to_hot FROM tr WHERE to_addr IN (SELECT addr FROM seed) GROUP BY 1)
SELECT addr, round(to_hot / 10000, 4) AS swept, round(inflow / 10000, 4) AS inflow, round(to_hot / inflow, 6) AS sweep_ratio
FROM swept JOIN recv USING (addr) WHERE to_hot / nullif(inflow, 0) >= 0.2 ORDER BY to_hot DESC, addr LIMIT 500"""),
)
def _sweeps(i: Inputs) -> DataFrame:
    out = R.deposit_sweeps(T.traces(i.spark, i.dir), T.hot_wallets(i.spark, i.dir), min_ratio=0.2, scale=1e4)
    return rounded(out, 4, sweep_ratio=6)


@query("flow_graph", compose("SELECT src, dst, round(usd, 4) AS usd, n_tx, confidence, source FROM edges"))
def _graph(i: Inputs) -> DataFrame:
    return rounded(i.edges(), 4)


@query("graph_parents", compose("SELECT dst AS child, string_agg(src, ',' ORDER BY src) AS parents FROM edges GROUP BY dst"))
def _parents(i: Inputs) -> DataFrame:
    return G.parents(i.edges()).select("child", F.array_join("parents", ",").alias("parents"))


@query("reversed_graph", compose("SELECT dst AS src, src AS dst, round(usd, 4) AS usd, n_tx, confidence FROM edges"))
def _reversed(i: Inputs) -> DataFrame:
    return rounded(G.reverse(i.edges()).drop("source"), 4)


@query("symmetric_graph", compose("SELECT src, dst FROM edges UNION SELECT dst, src FROM edges"))
def _symmetric(i: Inputs) -> DataFrame:
    return G.symmetric(i.edges())


@query(
    "documented_edges_reversed",
    compose("""
SELECT CASE WHEN source = 'documented' THEN dst ELSE src END AS src, CASE WHEN source = 'documented' THEN src ELSE dst END AS dst, source FROM edges"""),
)
def _edge_type_reversed(i: Inputs) -> DataFrame:
    return G.reverse_where(i.edges(), F.col("source") == G.DOCUMENTED).select("src", "dst", "source")


@query("seed_subgraph", compose("SELECT src, dst, round(usd, 4) AS usd FROM edges WHERE src IN (FROM seed_names) AND dst IN (FROM seed_names)"))
def _induced(i: Inputs) -> DataFrame:
    return rounded(G.induced(i.edges(), i.seed_names().withColumnRenamed("name", "entity")).select("src", "dst", "usd"), 4)


@query("graph_without_residual", compose("SELECT src, dst, round(usd, 4) AS usd FROM edges WHERE src <> 'retail' AND dst <> 'retail'"))
def _no_residual(i: Inputs) -> DataFrame:
    return rounded(G.without_node(i.edges()).select("src", "dst", "usd"), 4)


@query("graph_without_documented_pairs", compose("SELECT src, dst, round(usd, 4) AS usd FROM edges e WHERE NOT EXISTS (FROM documented d WHERE d.src = e.src AND d.dst = e.dst)"))
def _without_edges(i: Inputs) -> DataFrame:
    return rounded(G.without_edges(i.edges(), i.documented()).select("src", "dst", "usd"), 4)


@query(
    "graph_size",
    compose("""
SELECT (SELECT count(*) FROM nodes) AS n_nodes, count(*) AS n_edges, count(*) FILTER (source = 'observed_flow') AS n_observed,
  count(*) FILTER (source = 'documented') AS n_documented FROM edges"""),
)
def _size(i: Inputs) -> DataFrame:
    return G.graph_size(i.edges(), G.graph_nodes(i.flows(), i.documented()))


@query("reachability", compose("SELECT src, dst FROM reach"))
def _reach(i: Inputs) -> DataFrame:
    return G.reachability(i.edges())


@query(
    "volume_coverage",
    compose("""
SELECT round(sum(usd), 4) AS total_usd, round(sum(usd) FILTER (src <> 'retail' AND dst <> 'retail') / sum(usd), 6) AS named_both_sides,
  round(sum(usd) FILTER (src <> 'retail' OR dst <> 'retail') / sum(usd), 6) AS touching_named,
  (SELECT count(*) FROM nodes WHERE entity <> 'retail') AS n_named_entities FROM flows_k"""),
)
def _coverage(i: Inputs) -> DataFrame:
    return rounded(G.volume_coverage(i.flows(), G.graph_nodes(i.flows(), i.documented())), 6, total_usd=4)


CTES["addr_adj"] = """
SELECT i, j, sum(w) AS w FROM (SELECT from_addr AS i, to_addr AS j, ln(1 + volume) AS w FROM addr_edges
  UNION ALL SELECT to_addr, from_addr, ln(1 + volume) FROM addr_edges) GROUP BY i, j"""


@query(
    "normalized_adjacency",
    compose("""
SELECT a.i, a.j, round(a.w / sqrt((di.d + 1e-9) * (dj.d + 1e-9)), 6) AS w FROM addr_adj a
JOIN (SELECT i, sum(w) AS d FROM addr_adj GROUP BY i) di ON di.i = a.i JOIN (SELECT i, sum(w) AS d FROM addr_adj GROUP BY i) dj ON dj.i = a.j"""),
)
def _adjacency(i: Inputs) -> DataFrame:
    e = address_edges(i).withColumnsRenamed({"from_addr": "src", "to_addr": "dst"})
    return rounded(G.normalized_adjacency(e))
