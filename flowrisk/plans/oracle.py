"""The registered queries written a second time as SQL over the driver tables.

Relations build on each other as common table expressions; ``compose`` puts those a
statement names, directly or not, in front of it.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

# ---------------------------------------------------------------- domain relations
CTES["transfers"] = """
SELECT l_shipdate AS block_time, l_returnflag AS token,
  CASE WHEN l_linestatus = 'F' THEN concat('c', o_custkey) ELSE concat('s', l_suppkey) END AS from_addr,
  CASE WHEN l_linestatus = 'F' THEN concat('s', l_suppkey) ELSE concat('c', o_custkey) END AS to_addr,
  round(l_extendedprice * (1 - l_discount) * 10000) / power(10e0, 4) AS amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
CTES["seed"] = """
SELECT concat('s', s_suppkey) AS addr, n_name AS name, n_regionkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 = 0"""
CTES["seed_names"] = "SELECT DISTINCT name FROM seed"
CTES["seed_types"] = """
SELECT DISTINCT name, CASE n_regionkey WHEN 0 THEN 'CEX' WHEN 1 THEN 'STABLECOIN_ISSUER' WHEN 2 THEN 'LENDING'
  WHEN 3 THEN 'LST' ELSE 'CEX' END AS type FROM seed"""
CTES["labels_raw"] = """
SELECT concat('s', s_suppkey) AS addr,
  CASE s_suppkey % 3 WHEN 0 THEN concat(n_name, ' ', s_suppkey) WHEN 1 THEN concat(n_name, ' Hot Wallet') ELSE n_name END AS name
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('s', s_suppkey), concat(n_name, ' Cold 2')
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 = 0
UNION ALL SELECT concat('c', c_custkey), concat(n_name, ' Deposit ', c_custkey)
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'"""
CTES["label1"] = "SELECT addr, max(name) AS name FROM labels_raw GROUP BY addr"
CTES["roots"] = """
SELECT name, CASE WHEN name IN (SELECT name FROM seed_names) THEN name
  ELSE regexp_replace(name, ' (?:[0-9]+|Hot|Cold|Deposit)( .*)?$', '') END AS root
FROM (SELECT DISTINCT name FROM label1 UNION SELECT name FROM seed_names)"""


def xfer(unit: str) -> str:
    return f"""
SELECT date_trunc('{unit}', t.block_time)::TIMESTAMP AS bucket, t.token, t.amount,
  coalesce(sf.name, cf.name, 'retail') AS from_name, coalesce(st.name, ct.name, 'retail') AS to_name,
  CASE WHEN sf.name IS NOT NULL THEN 'seed' WHEN cf.name IS NOT NULL THEN 'dune_cex' ELSE 'retail' END AS from_src,
  CASE WHEN st.name IS NOT NULL THEN 'seed' WHEN ct.name IS NOT NULL THEN 'dune_cex' ELSE 'retail' END AS to_src,
  sf.name AS from_seed, st.name AS to_seed
FROM transfers t LEFT JOIN seed sf ON t.from_addr = sf.addr LEFT JOIN seed st ON t.to_addr = st.addr
LEFT JOIN label1 cf ON t.from_addr = cf.addr LEFT JOIN label1 ct ON t.to_addr = ct.addr"""


def resolved(unit: str, floor: float) -> str:
    return f"""
SELECT bucket, src, dst, sum(usd) AS usd, sum(n_tx)::BIGINT AS n_tx, max(src_prov) AS src_prov, max(dst_prov) AS dst_prov
FROM (SELECT bucket, coalesce(rf.root, from_name) AS src, coalesce(rt.root, to_name) AS dst, usd, n_tx, src_prov, dst_prov
  FROM (SELECT bucket, from_name, to_name, sum(amount) AS usd, count(*) AS n_tx, max(from_src) AS src_prov, max(to_src) AS dst_prov
    FROM xfer_{unit} WHERE NOT (from_name = 'retail' AND to_name = 'retail')
    GROUP BY ALL HAVING sum(amount) >= {floor}) g
  LEFT JOIN roots rf ON g.from_name = rf.name LEFT JOIN roots rt ON g.to_name = rt.name)
WHERE src <> dst GROUP BY bucket, src, dst"""


def collapsed(flows: str, keep: str) -> str:
    return f"""
SELECT bucket, src, dst, sum(usd) AS usd, sum(n_tx)::BIGINT AS n_tx, max(src_prov) AS src_prov, max(dst_prov) AS dst_prov
FROM (SELECT bucket, CASE WHEN src IN (SELECT name FROM {keep}) THEN src ELSE 'retail' END AS src,
  CASE WHEN dst IN (SELECT name FROM {keep}) THEN dst ELSE 'retail' END AS dst, usd, n_tx, src_prov, dst_prov FROM {flows})
WHERE src <> dst GROUP BY bucket, src, dst"""


for _unit in ("week", "day", "month"):
    CTES[f"xfer_{_unit}"] = xfer(_unit)
CTES["flows"] = resolved("week", 10000)
CTES["flows_day"] = resolved("day", 10000)
CTES["flows_month"] = resolved("month", 10000)


def throughput(flows: str) -> str:
    return f"""
SELECT entity, sum(usd) AS usd FROM (SELECT src AS entity, usd FROM {flows} UNION ALL SELECT dst, usd FROM {flows}) GROUP BY entity"""


def keep_set(flows: str, k: int) -> str:
    return f"""
SELECT name FROM (SELECT entity AS name FROM ({throughput(flows)}) WHERE entity <> 'retail' ORDER BY usd DESC, entity LIMIT {k})
UNION SELECT name FROM seed_names"""


CTES["keep"] = keep_set("flows", 12)
CTES["flows_k"] = collapsed("flows", "keep")
CTES["flows_seed"] = collapsed("flows", "seed_names")
CTES["documented"] = """
SELECT concat('NATION_', k) AS src, concat('NATION_', (k + 1) % 25) AS dst FROM range(0, 25, 2) r(k)"""


def graph(flows: str, documented: bool = True) -> str:
    totals = f"SELECT src, dst, sum(usd) AS usd, sum(n_tx)::BIGINT AS n_tx FROM {flows} GROUP BY src, dst"
    sql = f"""
SELECT src, dst, usd, n_tx, CASE WHEN src = 'retail' OR dst = 'retail' THEN 0.5e0 ELSE 1e0 END AS confidence,
  'observed_flow' AS source FROM ({totals}) t
WHERE src <> dst AND usd >= (SELECT quantile_cont(usd, 0.5) FROM ({totals}))"""
    if documented:
        sql = f"""WITH obs AS ({sql}) SELECT * FROM obs UNION ALL
SELECT d.src, d.dst, coalesce(t.usd, 0), 0, 0.7e0, 'documented' FROM documented d
LEFT JOIN ({totals}) t ON d.src = t.src AND d.dst = t.dst
WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.src = d.src AND o.dst = d.dst)"""
    return sql


CTES["edges"] = graph("flows_k")
CTES["edges_seed"] = graph("flows_seed")
CTES["nodes"] = """
SELECT src AS entity FROM flows_k UNION SELECT dst FROM flows_k UNION SELECT src FROM documented UNION SELECT dst FROM documented"""
CTES["ents"] = "SELECT src AS entity FROM flows_k UNION SELECT dst FROM flows_k UNION SELECT name FROM seed_names"
CTES["ents_seed"] = "SELECT src AS entity FROM flows_seed UNION SELECT dst FROM flows_seed UNION SELECT name FROM seed_names"
CTES["reach"] = """
WITH RECURSIVE r(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src)
SELECT src, dst FROM r"""
CTES["addr_edges"] = """
SELECT from_addr, to_addr, sum(amount) AS volume, count(*) AS n_tx FROM transfers GROUP BY from_addr, to_addr"""

# ---------------------------------------------------------------- series
CTES["quotes"] = """
SELECT ts, key, price FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, event_type AS key, value AS price,
  row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY e.ts DESC, event_id DESC) AS rn FROM events e) WHERE rn = 1"""


def filled(prices: str) -> str:
    return f"""
SELECT ts, key, last_value(price IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts) AS price
FROM (SELECT c.ts, k.key, p.price FROM (SELECT DISTINCT ts FROM {prices}) c CROSS JOIN (SELECT DISTINCT key FROM {prices}) k
  LEFT JOIN {prices} p ON p.ts = c.ts AND p.key = k.key)"""


def returns(panel: str) -> str:
    return f"""
SELECT * FROM (SELECT ts, key, ln(price / lag(price) OVER (PARTITION BY key ORDER BY ts)) AS value FROM {panel}) WHERE value IS NOT NULL"""


def complete(panel: str) -> str:
    return f"""
SELECT * FROM {panel} WHERE ts IN (SELECT ts FROM {panel} GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT key) FROM {panel}))"""


def z(x: str, win: int, least: int, by: str = "key") -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY ts ROWS BETWEEN {win - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"coalesce(CASE WHEN count({x}) {w} >= {least} AND max({x}) {w} <> min({x}) {w} "
        f"THEN ({x} - avg({x}) {w}) / stddev_samp({x}) {w} END, 0)"
    )


def peak_loss(x: str, win: int, least: int) -> str:
    w = f"OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN {win - 1} PRECEDING AND CURRENT ROW)"
    return f"greatest(coalesce(1 - {x} / CASE WHEN count({x}) {w} >= {least} THEN max({x}) {w} END, 0), 0)"


CTES["quotes_filled"] = filled("quotes")
CTES["hour_returns"] = returns("quotes_filled")
CTES["week_prices"] = """
SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS ts, o_orderpriority AS key, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2"""
CTES["day_prices"] = """
SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, o_orderpriority AS key, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2"""
CTES["week_filled"] = filled("week_prices")
CTES["week_returns"] = returns("week_filled")
CTES["week_complete"] = complete("week_returns")
CTES["peg_prices"] = """
SELECT ts, p.key, price / m AS price FROM week_prices p JOIN (SELECT key, avg(price) AS m FROM week_prices GROUP BY key) a ON p.key = a.key"""
CTES["tvl"] = """
SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS ts, n_name AS key, sum(o_totalprice) AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""
CTES["entity_asset"] = """
SELECT n_name AS entity, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][n_nationkey % 5 + 1] AS asset FROM nation"""


# ---------------------------------------------------------------- stress
def flow_series(flows: str, ents: str) -> str:
    return f"""
SELECT c.ts, e.entity AS key, coalesce(i.v, 0) AS inflow, coalesce(o.v, 0) AS outflow, coalesce(o.v, 0) - coalesce(i.v, 0) AS net_outflow
FROM (SELECT DISTINCT bucket AS ts FROM {flows}) c CROSS JOIN {ents} e
LEFT JOIN (SELECT bucket, dst, sum(usd) AS v FROM {flows} GROUP BY 1, 2) i ON i.bucket = c.ts AND i.dst = e.entity
LEFT JOIN (SELECT bucket, src, sum(usd) AS v FROM {flows} GROUP BY 1, 2) o ON o.bucket = c.ts AND o.src = e.entity"""


def ratio(series: str, win: int, least: int) -> str:
    w = f"OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN {win - 1} PRECEDING AND CURRENT ROW)"
    t = "(inflow + outflow)"
    return f"""
SELECT *, inflow + outflow AS total,
  coalesce(net_outflow / CASE WHEN count(*) {w} >= {least} THEN nullif(avg({t}) {w}, 0) END, 0) AS ratio FROM {series}"""


def flow_stress(series: str, win: int, least: int) -> str:
    return f"""
SELECT ts, key, 0.6e0 * {z('ratio', win, least)} + 0.4e0 * {z('total', win, least)} AS value FROM ({ratio(series, win, least)})"""


CTES["series"] = flow_series("flows_k", "ents")
CTES["series_seed"] = flow_series("flows_seed", "ents_seed")
CTES["panel0"] = flow_stress("series", 48, 6)
CTES["panel"] = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS pos FROM panel0"
CTES["panel_seed0"] = flow_stress("series_seed", 48, 6)
CTES["panel_seed"] = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS pos FROM panel_seed0"


def on_calendar(prices: str, asset_of: str, col: str = "price", flows: str = "flows_k") -> str:
    return f"""
SELECT c.ts, a.entity AS key, last_value(p.{col} IGNORE NULLS) OVER (PARTITION BY a.entity ORDER BY c.ts) AS {col}
FROM (SELECT DISTINCT bucket AS ts FROM {flows}) c CROSS JOIN ({asset_of}) a LEFT JOIN {prices} p ON p.ts = c.ts AND p.key = a.ref"""


def compose(sql: str, **extra: str) -> str:
    """``sql`` preceded by every relation it needs."""
    pool = CTES | extra
    needed: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", todo.pop()))
        for name in words & pool.keys() - needed:
            needed.add(name)
            todo.append(pool[name])
    parts = [f"{n} AS MATERIALIZED ({pool[n].strip()})" for n in pool if n in needed]
    sql = sql.strip()
    if not parts:
        return sql
    tail = ",\n" + sql.removeprefix("WITH ") if sql.startswith("WITH ") else "\n" + sql
    return "WITH " + ",\n".join(parts) + tail
