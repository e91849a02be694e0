"""Series and stress panel queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.functions.output import rounded
from flowrisk.operators import series as S
from flowrisk.operators import stress as X
from flowrisk.plans.inputs import Inputs
from flowrisk.plans.oracle import CTES, complete, compose, flow_stress, on_calendar, peak_loss, ratio, z
from flowrisk.plans.queries import query
from flowrisk.sources import market as M
from flowrisk.sources import tables as T


@query("hourly_prices", compose("SELECT ts, key, price FROM quotes"))
def _hourly(i: Inputs) -> DataFrame:
    return i.quotes()


@query("landed_price_documents", compose("SELECT ts, key, price FROM quotes"))
def _landed(i: Inputs) -> DataFrame:
    """Quotes packed into documents of the landed JSON layout, and read back."""
    docs = M.pack_price_documents(T.price_points(i.spark, i.dir))
    return M.price_series(docs, "hour")


@query("landed_tvl_documents", compose("""
SELECT ts, key, value FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, event_type AS key, value,
  row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY e.ts DESC, event_id DESC) AS rn FROM events e) WHERE rn = 1"""))
def _landed_tvl(i: Inputs) -> DataFrame:
    docs = M.pack_tvl_documents(T.price_points(i.spark, i.dir))
    return M.tvl_series(docs)


@query("price_panel", compose("SELECT ts, key, price FROM quotes_filled"))
def _price_panel(i: Inputs) -> DataFrame:
    return S.price_panel(i.quotes())


@query("hourly_log_returns", compose("SELECT ts, key, round(value, 6) + 0 AS value FROM hour_returns"))
def _hour_returns(i: Inputs) -> DataFrame:
    return rounded(S.log_returns(S.price_panel(i.quotes())))


@query("log_returns", compose("SELECT ts, key, round(value, 6) + 0 AS value FROM week_returns"))
def _returns(i: Inputs) -> DataFrame:
    return rounded(i.returns())


@query("complete_returns", compose("SELECT ts, key, round(value, 6) + 0 AS value FROM week_complete"))
def _complete(i: Inputs) -> DataFrame:
    return rounded(S.complete_cases(i.returns()))


@query("locked_value", compose("SELECT ts, key, round(value, 4) AS value FROM tvl"))
def _tvl(i: Inputs) -> DataFrame:
    return rounded(i.tvl(), 4)


@query("entity_flow_series", compose("""
SELECT ts, key, round(inflow, 4) AS inflow, round(outflow, 4) AS outflow, round(net_outflow, 4) + 0 AS net_outflow FROM series"""))
def _series(i: Inputs) -> DataFrame:
    return rounded(X.entity_flow_series(i.flows(), i.entities()), 4)


@query("flow_stress", compose("SELECT ts, key, round(value, 6) + 0 AS value FROM panel"))
def _flow_stress(i: Inputs) -> DataFrame:
    return rounded(i.panel())


@query("short_window_stress", compose(f"SELECT ts, key, round(value, 6) + 0 AS value FROM ({flow_stress('series', 14, 3)})"))
def _short(i: Inputs) -> DataFrame:
    return rounded(X.flow_stress(i.flows(), i.entities(), X.EVENT))


@query("rolling_zscores", compose(f"SELECT ts, key, round({z('price', 30, 5)}, 6) + 0 AS z, round({peak_loss('price', 30, 5)}, 6) AS drawdown FROM week_filled"))
def _zscores(i: Inputs) -> DataFrame:
    w = S.rolling(30, *S.SLICED)
    p = S.sliced(S.price_panel(i.prices()), 30)
    p = S.own(p.withColumns({"z": S.zscore(F.col("price"), w, 5), "drawdown": S.drawdown(F.col("price"), w, 5)}))
    return rounded(p.select("ts", "key", "z", "drawdown"))


# The typed panel: issuers are pegged to their asset, lenders locked in their own nation.
CTES["typed"] = f"""
SELECT r.ts, r.key, t.type, r.ratio, abs(1 - g.price) AS peg_dev, greatest(r.ratio, 0) AS redemption, v.value AS tvl, p.price AS px
FROM ({ratio("(SELECT * FROM series WHERE key <> 'retail')", 30, 5)}) r
JOIN (SELECT e.entity, coalesce(t.type, 'CEX') AS type FROM ents e LEFT JOIN seed_types t ON e.entity = t.name) t ON t.entity = r.key
LEFT JOIN ({on_calendar("peg_prices", "SELECT entity, asset AS ref FROM entity_asset")}) g ON g.ts = r.ts AND g.key = r.key
LEFT JOIN ({on_calendar("peg_prices", "SELECT entity, asset AS ref FROM entity_asset")}) p ON p.ts = r.ts AND p.key = r.key
LEFT JOIN ({on_calendar("tvl", "SELECT entity, entity AS ref FROM entity_asset", "value")}) v ON v.ts = r.ts AND v.key = r.key"""
CTES["typed_dd"] = f"SELECT *, {peak_loss('tvl', 30, 5)} AS tvl_dd, {peak_loss('px', 30, 5)} AS px_dd FROM typed"
CTES["market_dd"] = f"""
SELECT ts, key, {peak_loss('price', 30, 5)} AS dd FROM ({on_calendar("peg_prices", "SELECT 'retail' AS entity, '2-HIGH' AS ref")})"""
CTES["typed_panel"] = f"""
SELECT ts, key, CASE type WHEN 'CEX' THEN {z('ratio', 30, 5)} WHEN 'STABLECOIN_ISSUER' THEN 0.6e0 * {z('peg_dev', 30, 5)} + 0.4e0 * {z('redemption', 30, 5)}
  ELSE {z('tvl_dd', 30, 5)} + 0.5e0 * {z('px_dd', 30, 5)} END AS value FROM typed_dd
UNION ALL SELECT ts, key, {z('dd', 30, 5)} FROM market_dd"""


def typed_panel(i: Inputs) -> DataFrame:
    a = i.entity_assets()
    refs = a.select("entity", F.col("asset").alias("peg_ref"), F.col("entity").alias("tvl_ref"), F.col("asset").alias("price_ref"))
    return X.typed_stress(i.flows(), i.types(), refs, i.pegs(), i.tvl(), market="2-HIGH", roll=X.DAILY)


@query("typed_stress", compose("SELECT ts, key, round(value, 6) + 0 AS value FROM typed_panel"))
def _typed(i: Inputs) -> DataFrame:
    return rounded(typed_panel(i))


CTES["peg_z"] = f"""
SELECT ts, key, {z('abs(1 - price)', 48, 6)} AS peg FROM ({on_calendar("peg_prices", "SELECT 'NATION_0' AS entity, '1-URGENT' AS ref")})"""


@query("peg_augmented_stress", compose("""
SELECT p.ts, p.key, round(CASE WHEN g.peg IS NOT NULL THEN 0.5e0 * p.value + 0.5e0 * g.peg ELSE p.value END, 6) + 0 AS value
FROM panel p LEFT JOIN peg_z g ON g.ts = p.ts AND g.key = p.key"""))
def _pegged(i: Inputs) -> DataFrame:
    peg = X.peg_stress(X.calendar(i.flows()), i.pegs(), "1-URGENT", "NATION_0", X.HOURLY)
    return rounded(X.with_peg(i.panel(), peg))


@query("event_stress", compose(f"""
SELECT ts, key, round(value, 6) + 0 AS value FROM (SELECT ts, key, value FROM ({flow_stress('series', 14, 3)})
UNION ALL SELECT ts, 'market_peg', {z('abs(1 - price)', 14, 3)} FROM ({on_calendar("peg_prices", "SELECT 'market_peg' AS entity, '1-URGENT' AS ref")}))"""))
def _event(i: Inputs) -> DataFrame:
    peg = X.peg_stress(X.calendar(i.flows()), i.pegs(), "1-URGENT", "market_peg", X.EVENT)
    return rounded(X.flow_stress(i.flows(), i.entities(), X.EVENT).unionByName(peg))


CTES["nonflow_source"] = """
SELECT e.entity, CASE WHEN a.asset IN ('1-URGENT', '3-MEDIUM') THEN 'peg' ELSE 'drawdown' END AS kind, coalesce(a.asset, '2-HIGH') AS ref
FROM ents e LEFT JOIN entity_asset a ON e.entity = a.entity"""
CTES["nonflow_px"] = f"""
SELECT p.*, s.kind FROM ({on_calendar("peg_prices", "SELECT entity, ref FROM nonflow_source")}) p JOIN nonflow_source s ON s.entity = p.key"""
CTES["nonflow_panel0"] = f"""
SELECT ts, key, {z('sig', 48, 6)} AS value
FROM (SELECT ts, key, CASE WHEN kind = 'peg' THEN abs(1 - price) ELSE {peak_loss('price', 48, 6)} END AS sig FROM nonflow_px)"""
CTES["nonflow_panel"] = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS pos FROM nonflow_panel0"


def nonflow_panel(i: Inputs) -> DataFrame:
    kind = F.when(F.col("asset").isin("1-URGENT", "3-MEDIUM"), "peg").otherwise("drawdown")
    known = i.entity_assets().select("entity", kind.alias("kind"), "asset")
    sources = X.nonflow_sources(i.entities(), known, "drawdown", "2-HIGH")
    return X.nonflow_stress(X.calendar(i.flows()), i.pegs(), sources, X.HOURLY)


@query("nonflow_stress", compose("SELECT ts, key, round(value, 6) + 0 AS value FROM nonflow_panel"))
def _nonflow(i: Inputs) -> DataFrame:
    return rounded(nonflow_panel(i))


def normal_sql(*parts: str) -> str:
    h = f"md5(concat_ws(':', {', '.join(parts)}))"
    word = "('0x' || substr({h}, {at}, 8))::BIGINT"
    u1 = f"({word.format(h=h, at=1)} + 1) / 4294967297e0"
    u2 = f"{word.format(h=h, at=9)} / 4294967296e0"
    return f"(sqrt(-2e0 * ln({u1})) * cos(2e0 * pi() * {u2}))"


CTES["latent"] = f"""
WITH e AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM (SELECT DISTINCT ts FROM panel)),
n AS (SELECT ts, pos, {normal_sql("'latent'", '11', 'pos')} AS eps FROM e),
x AS (SELECT ts, list_reduce(list(eps) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, b: 0.7e0 * a + b, 0e0) AS x FROM n)
SELECT ts, (x - (SELECT avg(x) FROM x)) / (SELECT stddev_samp(x) FROM x) AS shock FROM x"""


@query("latent_shock_stress", compose("SELECT p.ts, p.key, round(p.value + 0.3e0 * l.shock, 6) + 0 AS value FROM panel p JOIN latent l ON p.ts = l.ts"))
def _latent(i: Inputs) -> DataFrame:
    return rounded(X.inject(i.panel(), X.latent_shock(i.panel(), 11), 0.3))
