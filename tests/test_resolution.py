"""Address resolution as a job, results written and read again, and reports that say why something is missing."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowrisk.operators import address as A
from flowrisk.operators import resolve as R
from flowrisk import session
from flowrisk.plans import address_queries as Q
from flowrisk.plans import jobs
from flowrisk.plans.inputs import Inputs
from flowrisk.sources import sinks
from flowrisk.sources import tables as T

SF = "/root/testdata/sf0.001"


def edge_table(spark, pairs):
    return spark.createDataFrame([(a, b, float(v), 1) for a, b, v in pairs], "from_addr string, to_addr string, volume double, n_tx long")


def test_job_learns_what_the_labels_are(spark):
    i = Inputs(spark, SF)
    rel = jobs.Relations(i.transfers(), i.tokens(), i.seed(), T.address_labels(spark, SF), i.prices(), i.entity_assets())
    symbol = i.tokens().orderBy("sym").first()["sym"]
    out = jobs.resolution(rel, symbol, k=5, dim=4)
    r = out["report"].first()
    assert r.reason is None and r.n_labelled >= 10 and 0 < r.base_rate < 1
    assert 0 <= r.auc <= 1 and 0 <= r.cluster_homogeneity <= 1 and r.n_test == out["scores"].count() > 0
    ends = A.address_edges(rel.transfers, rel.tokens.where(F.col("sym") == symbol))
    addresses = ends.select("from_addr").union(ends.select("to_addr")).distinct().count()
    assert r.n_addresses == addresses == out["clusters"].count()
    assert out["clusters"].select("cluster").distinct().count() <= 5


def test_report_gives_reasons(spark):
    labels = spark.createDataFrame([("a", "X"), ("b", "Y")], "addr string, name string")
    few = A.resolution(edge_table(spark, [("a", "b", 5), ("b", "c", 2), ("c", "d", 1), ("d", "a", 1)]), labels, k=2, dim=2)
    r = few["report"].first()
    assert "scores" not in few and r.reason == "fewer than 10 addresses of a class" and r.auc is None
    assert (r.n_addresses, r.n_labelled, r.n_distinct_labels) == (4, 2, 2) and 0 <= r.cluster_homogeneity <= 1
    nothing = A.resolution(edge_table(spark, [(A.NULL_ADDRESS, "b", 5)]), labels)
    assert list(nothing) == ["report"] and nothing["report"].first().reason == "no edges" and nothing["report"].first().n_addresses == 0


def test_sentinel_is_left_out_on_either_side(spark):
    edges = edge_table(spark, [("a", "b", 1), (A.NULL_ADDRESS, "a", 9), ("b", A.NULL_ADDRESS, 7), (A.NULL_ADDRESS, A.NULL_ADDRESS, 3)])
    assert [tuple(r) for r in A.without_sentinel(edges).collect()] == [("a", "b", 1.0, 1)]
    nodes = {r.addr: r for r in A.node_features(A.without_sentinel(edges), spark.createDataFrame([], "addr string, name string")).collect()}
    assert set(nodes) == {"a", "b"} and nodes["a"].in_vol == 0 and nodes["b"].out_vol == 0


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_results_are_read_back(spark, tmp_path, fmt):
    table = spark.createDataFrame([("a", 1.5, None), ("é\n", None, 7), (None, float("-inf") if fmt == "parquet" else 0.0, 2**60)], "k string, x double, n long")
    jobs.save_all({"one": table, "none": table.limit(0)}, str(tmp_path), fmt)
    again = sinks.load_result(spark, f"{tmp_path}/one", "k string, x double, n long", fmt)
    assert {tuple(r) for r in again.select("k", "x", "n").collect()} == {tuple(r) for r in table.collect()}
    if fmt == "parquet":
        assert sinks.load_result(spark, f"{tmp_path}/none").schema == table.schema


def test_flows_are_grouped_by_numbers_not_names(spark, capsys):
    """Odd books included: a label that is the residual's name, missing names and provenances, two addresses of one name."""
    book = [("a", "X 1", "seed", "X"), ("b", "Y", "dune_cex", "Y"), ("c", "Y", "seed", "Y"), ("d", "retail", "dune_cex", "Z"), ("e", None, None, None), ("f", None, "seed", "W")]
    ends = "abcdefg"
    rows = [("2000-01-%02d 05:00:00" % (1 + (7 * k) % 28), "T", ends[k % 7], ends[(k // 7) % 7], 100 * k) for k in range(300)]
    transfers = spark.createDataFrame(rows, "t string, token_addr string, from_addr string, to_addr string, value long").select(
        F.to_timestamp_ntz("t").alias("block_time"), "token_addr", "from_addr", "to_addr", "value")
    tokens = spark.createDataFrame([("T", "T", 2)], "token_addr string, sym string, dec int")
    books = spark.createDataFrame(book, "addr string, name string, prov string, root string")
    flows = R.resolved_flows(transfers, tokens, books, "week", 500.0)
    flows.explain()
    plan = capsys.readouterr().out
    assert "from_id" in plan and "from_name" not in plan and "date_trunc" not in plan

    known = {addr: [x or "retail" for x in rest] for addr, *rest in book}
    raw, out = {}, {}
    for t, _token, a, b, v in rows:
        (n, p, r), (m, q, s) = known.get(a, ["retail"] * 3), known.get(b, ["retail"] * 3)
        if n != "retail" or m != "retail":
            day = datetime.strptime(t, "%Y-%m-%d %H:%M:%S").replace(hour=0)
            raw.setdefault((day - timedelta(day.weekday()), n, m, r, s), []).append((v / 100, p, q))
    for (week, _n, _m, r, s), x in raw.items():
        if sum(v for v, *_ in x) >= 500 and r != s:
            out.setdefault((week, r, s), []).extend(x)
    want = {k: (round(sum(v for v, *_ in x), 6), len(x), max(p for _, p, _ in x), max(q for *_, q in x)) for k, x in out.items()}
    got = {(r.bucket, r.src, r.dst): (round(r.usd, 6), r.n_tx, r.src_prov, r.dst_prov) for r in flows.collect()}
    assert got == want and len(got) > 5


def test_whole_is_the_rounded_number(spark):
    xs = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 123456.5, 123456.49999999999, 4503599627370495.5, -4503599627370495.5, 9007199254740993.0, 1e17, 0.0, -0.0]
    odd = [None, float("nan"), float("inf")]
    df = spark.createDataFrame([(x,) for x in xs + odd], "x double")
    r = df.select(T.whole(F.col("x")).alias("a"), F.round("x").cast("decimal(18,0)").alias("b"))
    assert r.schema["a"].dataType == r.schema["b"].dataType and r.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty()


def test_edges_are_written_only_for_several_readers(spark, monkeypatch):
    session.forget_stages()
    written, write = [], session.write_table
    monkeypatch.setattr(session, "write_table", lambda df, name="step": written.append(name) or write(df, name))
    i = Inputs(spark, SF)
    alone = Q.nodes(i)
    assert "address-edges" not in written and "address-nodes" in written
    session.forget_stages()
    Q.edges(i)
    again = Q.nodes(i)
    assert written.count("address-edges") == 1
    r = lambda df: df.select("addr", F.round("out_vol", 4), F.round("in_vol", 4), "deg", "tot_tx", "is_labelled")
    assert r(alone).exceptAll(r(again)).isEmpty() and alone.count() == again.count() > 0
    session.forget_stages()


def test_amounts_are_taken_before_the_join(spark, capsys):
    T.transfers(spark, SF).explain()
    plan = capsys.readouterr().out
    join = plan[plan.index("Join"):]
    assert "l_extendedprice" not in plan[: plan.index("Join")] and "AS value" in join
