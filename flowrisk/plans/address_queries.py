"""Address graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.functions.draws import hash_index
from flowrisk.functions.output import rounded
from flowrisk.operators import address as A
from flowrisk.operators import resolve as R
from flowrisk.plans.inputs import Inputs
from flowrisk.plans.oracle import CTES, compose
from flowrisk.plans.queries import query
from flowrisk.sources import tables as T


def _address_edges(i: Inputs) -> DataFrame:
    return A.without_sentinel(A.address_edges(i.transfers(), i.tokens()))


def edges(i: Inputs) -> DataFrame:
    return i._stage("address-edges", lambda: _address_edges(i))


def labels(i: Inputs) -> DataFrame:
    return R.dedupe_labels(T.address_labels(i.spark, i.dir))


def nodes(i: Inputs) -> DataFrame:
    """Node features read the edges once, and there are nearly as many edges as transfers, so they are not written for them alone."""
    return i._stage("address-nodes", lambda: A.node_features(i._once("address-edges", lambda: _address_edges(i)), labels(i)))


@query("address_edges", compose("""
SELECT from_addr, to_addr, round(volume, 4) AS volume, n_tx, f.name AS from_label, t.name AS to_label
FROM addr_edges e LEFT JOIN label1 f ON f.addr = e.from_addr LEFT JOIN label1 t ON t.addr = e.to_addr"""))
def _edges(i: Inputs) -> DataFrame:
    return rounded(A.labelled_edges(edges(i), labels(i)), 4)


CTES["node"] = """
SELECT coalesce(o.addr, n.addr) AS addr, coalesce(out_vol, 0) AS out_vol, coalesce(out_tx, 0)::BIGINT AS out_tx, coalesce(out_deg, 0) AS out_deg,
  coalesce(in_vol, 0) AS in_vol, coalesce(in_tx, 0)::BIGINT AS in_tx, coalesce(in_deg, 0) AS in_deg, coalesce(top / out_vol, 0) AS sweep_ratio
FROM (SELECT from_addr AS addr, sum(volume) AS out_vol, sum(n_tx) AS out_tx, count(DISTINCT to_addr) AS out_deg, max(volume) AS top FROM addr_edges GROUP BY 1) o
FULL JOIN (SELECT to_addr AS addr, sum(volume) AS in_vol, sum(n_tx) AS in_tx, count(DISTINCT from_addr) AS in_deg FROM addr_edges GROUP BY 1) n ON o.addr = n.addr"""


@query("address_features", compose("""
SELECT n.addr, round(out_vol, 4) AS out_vol, out_tx, out_deg, round(in_vol, 4) AS in_vol, in_tx, in_deg, round(sweep_ratio, 6) AS sweep_ratio,
  round(out_vol + in_vol, 4) AS tot_vol, out_tx + in_tx AS tot_tx, out_deg + in_deg AS deg, round(in_vol / (out_vol + 1), 6) AS in_out_ratio,
  l.name AS label, (l.name IS NOT NULL)::INT AS is_labelled FROM node n LEFT JOIN label1 l ON l.addr = n.addr"""))
def _features(i: Inputs) -> DataFrame:
    return rounded(nodes(i), 4, sweep_ratio=6, in_out_ratio=6)


# The sweep and the report take any score; here it is the degree, which SQL can rank as well.
CTES["scored"] = """
SELECT (out_deg + in_deg)::DOUBLE AS score, (l.name IS NOT NULL)::INT AS y, out_vol + in_vol AS vol FROM node n LEFT JOIN label1 l ON l.addr = n.addr"""
CTES["sweep"] = """
WITH s AS (SELECT score, sum(y) AS tp_here, sum(1 - y) AS fp_here, sum(vol * y) AS tpv, sum(vol * (1 - y)) AS fpv FROM scored GROUP BY score),
c AS (SELECT *, sum(tp_here) OVER w AS tp, sum(fp_here) OVER w AS fp, sum(tpv) OVER w AS tp_vol, sum(fpv) OVER w AS fp_vol FROM s WINDOW w AS (ORDER BY score DESC))
SELECT *, tp / (tp + fp) AS precision, tp / (SELECT sum(y) FROM scored) AS recall FROM c"""


def scored(i: Inputs) -> DataFrame:
    return nodes(i).select(F.col("deg").cast("double").alias("score"), F.col("is_labelled").alias("y"), F.col("tot_vol").alias("vol"))


@query("threshold_sweep", compose("""
SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp_vol, 2) AS tp_vol, round(fp_vol, 2) AS fp_vol, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(CASE WHEN tp = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM sweep"""))
def _sweep(i: Inputs) -> DataFrame:
    cols = ["score", "tp", "fp", "tp_vol", "fp_vol", "precision", "recall", "f1"]
    return rounded(A.threshold_sweep(scored(i)).select(*cols), 6, tp_vol=2, fp_vol=2)


@query("degree_score_report", compose("""
WITH f AS (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM sweep),
b AS (SELECT * FROM f ORDER BY f1 DESC, score LIMIT 1), p AS (SELECT sum(tp_here) AS p, sum(fp_here) AS q, sum(tpv) AS v FROM sweep)
SELECT (p + q)::BIGINT AS n_test, p::BIGINT AS n_test_positive, round((SELECT sum(fp_here * (tp - tp_here / 2)) FROM sweep) / (p * q), 6) AS auc,
  round((SELECT sum(tp_here * precision) FROM sweep) / p, 6) AS avg_precision, round(b.f1, 6) AS best_f1, b.score AS threshold, round(b.precision, 6) AS precision,
  round(b.recall, 6) AS recall, round(b.tp_vol / (b.tp_vol + b.fp_vol), 6) AS vol_precision, round(b.tp_vol / v, 6) AS vol_recall FROM b, p"""))
def _degree_report(i: Inputs) -> DataFrame:
    return rounded(A.classification_report(scored(i)))


def classifier(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Held-out scores and importances, as stages."""
    trained: list = []

    def part(k: int) -> DataFrame:
        if not trained:
            found = A.train_classifier(nodes(i))
            if found is None:
                raise ValueError("too few addresses with or without a label to train on")
            trained.extend(found)
        return trained[k]

    return i._stage("classifier-scores", lambda: part(0)), i._stage("classifier-importance", lambda: part(1))


@query("address_classifier")
def _classifier(i: Inputs) -> DataFrame:
    scores, importance = classifier(i)
    top = importance.orderBy(F.desc("importance")).limit(5)
    names = top.agg(F.array_join(F.collect_list(F.concat_ws("=", "feature", F.round("importance", 3))), ",")).scalar()
    return rounded(A.classification_report(scores).select("*", names.alias("top_features")))


@query("hash_cluster_homogeneity", compose("""
WITH c AS (SELECT root AS class, ('0x' || substr(md5(concat_ws(':', 'cluster', addr)), 1, 8))::BIGINT % 20 AS cluster
  FROM (SELECT l.addr, coalesce(s.name, r.root) AS root FROM label1 l LEFT JOIN seed s ON s.addr = l.addr LEFT JOIN roots r ON r.name = l.name)),
cell AS (SELECT class, cluster, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT sum(n) AS t FROM cell)
SELECT round(1 - (SELECT -sum(n / t * ln(n / nk)) FROM cell JOIN (SELECT cluster, sum(n) AS nk FROM cell GROUP BY cluster) k ON k.cluster = cell.cluster, t)
  / (SELECT -sum(n / t * ln(n / t)) FROM (SELECT class, sum(n) AS n FROM cell GROUP BY class), t), 6) AS homogeneity, (SELECT t::BIGINT FROM t) AS n"""))
def _hash_homogeneity(i: Inputs) -> DataFrame:
    c = i.book().select(F.col("root").alias("class"), hash_index(F.lit(20), "cluster", F.col("addr")).alias("cluster"))
    return rounded(A.homogeneity(c))


def embedding(i: Inputs) -> DataFrame:
    return i._stage("embedding", lambda: A.embed(edges(i))[0])


def clusters(i: Inputs) -> DataFrame:
    return i._stage("clusters", lambda: A.cluster(embedding(i)))


@query("graph_embedding")
def _embedding(i: Inputs) -> DataFrame:
    return embedding(i).select("addr", *[F.round(F.get("q", F.lit(c)), 6).alias(f"e{c}") for c in range(16)])


@query("embedding_clusters")
def _clusters(i: Inputs) -> DataFrame:
    return clusters(i).groupBy("cluster").agg(F.count("*").alias("n"))


@query("resolution_report")
def _report(i: Inputs) -> DataFrame:
    """Node and label counts with the classifier's and the clustering's quality, one row."""
    edges(i)  # the nodes and the embedding both read them
    scores, _importance = classifier(i)
    return rounded(A.resolution_report(nodes(i), scores, clusters(i)))
