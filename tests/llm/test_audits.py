"""Licence scan, source audit and vector codes against brute force on hostile fixtures, and the new cases of earlier operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from flowrisk.llm import decontamination, divergence, licenses, token_counts, vector_codes
from flowrisk.session import write_table

SF = "/root/testdata/sf0.001"
CLASH = ["key", "label", "n", "p", "q", "term", "zero", "places", "score", "__w", "word", "x", "code", "values", "rank", "v"]


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


@pytest.mark.parametrize("name", ["op11_licenses", "op12_divergence", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    theirs = Counter(tuple(dict(zip(columns, r, strict=True)).items()) for r in cur.fetchall())
    ours = Counter(tuple((c, r[c]) for c in columns) for r in queries()[name](spark, SF).collect())
    assert ours == theirs


# licences


TEMPLATES = (
    licenses.Template("mit", "under the mit license", base=True),
    licenses.Template("apache-2", "apache license version 2", base=True),
    licenses.Template("cc-by-nc", "cc by nc", base=True),
    licenses.Template("twice", "mit mit license", base=True),
    licenses.Template("gpl", "this work is licensed under the gnu public license", ("gnu public license",)),
    licenses.Template("two", "alpha beta gamma delta epsilon", ("alpha beta", "epsilon")),
)
TEXTS = [
    None, "", " .,;", "Released under the MIT License.", "UNDER THE MIT LICENSE, under the mit-license; under the mit licenses",
    "Licensed under the Apache License, Version 2.0", "cc by nc cc by nc", "CC BY-NC 4.0", "cc-by\nnc", "éunder the mit license", "under the mit licensé",
    "gnu public license", "this work is licensed under the gnu public license", "THIS work is under the gnu public license", "mit mit mit license",
    "alpha beta x y epsilon", "alpha beta gamma y epsilon", "alpha beta gamma delta", "under the mit license " * 3000, "licenKe under the mit license", "K", "İ mit",
    "a" * 50_000, "word " * 20_000 + "cc by nc", "apache license version 2" + " apache license version 2" * 10,
]


def brute_licenses(texts):
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    docs = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(upper)) for t in texts]
    df = Counter(w for d in docs for w in set(d))
    bits = lambda w: (len(docs) // (df[w] + 1)).bit_length()
    out = []
    for d in docs:
        starts, base, labels, best = [], set(), set(), 0.0
        for t in TEMPLATES:
            text, keys = t.words(), t.key_places()
            own = [bits(w) for w in text] if any(map(bits, text)) else [1] * len(text)
            for s in range(-keys[0], len(d)):
                at = lambda i: d[s + i] if 0 <= s + i < len(d) else None  # noqa: B023, E731
                if all(at(i) == text[i] for i in keys):
                    share = sum(x for i, x in enumerate(own) if at(i) == text[i]) / sum(own)
                    if t.base:
                        starts.append(s)
                        base.add(t.label)
                    if t.base or share >= licenses.MATCHED / 100:
                        labels.add(t.label)
                        best = max(best, share)
        ends = (min(starts), max(starts)) if starts else (None, None)
        out.append((len(d), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), best))
    return out


@pytest.fixture(scope="module")
def license_docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[5])]
    return write_table(clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))


def test_licenses(spark, license_docs):
    got = [tuple(r) for r in licenses.licenses(license_docs, templates=TEMPLATES).collect()]
    expected = brute_licenses([*TEXTS, TEXTS[3], TEXTS[5]])
    want = list(zip([*range(len(TEXTS)), 3, None], expected, strict=True))
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert [(r[0], r[1:7]) for r in order(got)] == [(k, e[:6]) for k, e in order(want)]
    assert [r[7] for r in order(got)] == pytest.approx([e[6] for _k, e in order(want)])
    by_id = {r[0]: r for r in got}
    assert by_id[16][6] == "two" and by_id[18][2] == 3000 and by_id[9][2] == 0


def test_licenses_edges(spark, license_docs):
    assert licenses.licenses(license_docs.limit(0), templates=TEMPLATES).count() == 0
    plan = licenses.licenses(license_docs, templates=TEMPLATES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    for bad in (licenses.Template("x", "gnu license", ("public license",)), licenses.Template("x", "lizenz für alle"), licenses.Template("x", " ")):
        with pytest.raises(ValueError):
            licenses.licenses(license_docs, templates=(bad,))


# source audit


def brute_audit(rows, least, top):
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(upper))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        v = len(kept)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * v) for t in kept}  # noqa: B023, E731
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        whole = shares(sum(counts.values(), Counter()))
        each = {s: shares(c) for s, c in counts.items()}
        for s, p in each.items():
            pairs = [(o, sum(gap(p[t], q[t]) for t in kept)) for o, q in each.items() if o != s]
            terms = [(t, gap(p[t], whole[t])) for t in kept if counts[s][t] and p[t] > whole[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return Counter(out)


def audit_rows(seed, sources, n=160):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "delta", "Élan", "élan", "zwölf", "don't", "x1y", "日本", "the", "of", "rare"]
    rows = [(" ".join(rng.choices(words, weights=range(1, 14), k=rng.randint(0, 12))), rng.choice(["en", "de", None]), f"s{rng.randrange(sources)}") for _ in range(n)]
    rows += [(None, "en", None), ("", "fr", "s0"), ("12 34", "fr", "s1"), ("solo", "it", "only"), ("the " * 5000, "en", "s0"), *[("the of", "en", "hot")] * 60]
    return rows


@pytest.mark.parametrize(("sources", "least", "steps"), [(4, 10, 1 << 20), (9, 2, 3), (1, 1000, 1)])
def test_audit(spark, monkeypatch, sources, least, steps):
    monkeypatch.setattr(divergence, "STEPS", steps)
    rows = audit_rows(sources, sources)
    docs = write_table(clashing(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)))
    got = Counter(tuple(r) for r in divergence.audit(docs, least, 3).collect())
    assert got == brute_audit(rows, least, 3)
    assert divergence.audit(docs.limit(0)).count() == 0


# vector codes


def brute_codes(rows, parts, entries, rounds):
    kept = sorted((i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v), lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _i, v, _l in kept[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda a, book: min((distance(a, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _i, v, _l in kept:
                groups[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)) if k in groups else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, [nearest(cut(v, p), books[p]) for p in range(parts)], lab) for i, v, lab in kept]
    total = Counter()
    for _i, f, lab in found:
        total[lab] += sum(d for d, _k in f)
    return Counter((i, "".join(f"{k:02x}" for _d, k in f), sum(d for d, _k in f), total[lab], digest) for i, f, lab in found)


def vectors(seed, n, size=8, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=size) * scale).tolist(), int(rng.integers(0, 3)) if i % 5 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0] * (size - 1) + [None], 1), (n + 2, [float("nan")] + [0.0] * (size - 1), 1), (n + 3, [float("inf")] + [0.0] * (size - 1), None)]
    rows += [(n + 4, [0.0] * size, 2), (n + 5, rows[0][1], 2), (n + 5, rows[0][1], 2), (-7, [-x for x in rows[1][1]], None)]
    return rows


@pytest.mark.parametrize(("n", "entries", "scale"), [(150, 16, 1.0), (3, 16, 1.0), (90, 256, 0.001), (60, 4, 3000.0)])
def test_codes(spark, monkeypatch, n, entries, scale):
    monkeypatch.setattr(vector_codes, "BLOCK", 32)
    rows = vectors(n, n, scale=scale)
    table = write_table(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)))
    how = vector_codes.Settings(parts=4, entries=entries, rounds=3)
    got = Counter(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in vector_codes.compressed(table, how).collect())
    assert got == brute_codes(rows, 4, entries, 3)


def test_codes_edges(spark):
    schema = "vec_id long, embedding array<float>, label string"
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    nothing = spark.createDataFrame([(1, None, "a")], schema)
    assert vector_codes.compressed(nothing).count() == 0 and vector_codes.compressed(nothing.limit(0)).columns == columns
    empty = hashlib.sha256(b"").hexdigest()
    uneven = spark.createDataFrame([(1, [0.0] * 6, "a"), (2, [], "a")], schema)
    assert sorted(tuple(r) for r in vector_codes.compressed(uneven).collect()) == [(1, None, None, None, empty), (2, None, None, None, empty)]
    mixed = spark.createDataFrame([(1, [0.0] * 4, "a"), (2, [1.0] * 4, None), (3, [1.0] * 8, "a"), (4, [], None)], schema)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.compressed(mixed).collect()}
    assert got == {1: ("00000000", 0, 0), 2: ("01010101", 0, 0), 3: (None, None, 0), 4: (None, None, 0)}
    with pytest.raises(ValueError):
        vector_codes.compressed(spark.createDataFrame([(1, [1e9] * 4, None)], schema))


def test_table_distances_equal_direct_ones():
    rng = np.random.default_rng(3)
    for reach in (5, 1000, 40_000_000):
        x, book = rng.integers(-reach, reach, (50, 6)), rng.integers(-reach, reach, (7, 6))
        direct = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (vector_codes.distances(*vector_codes.dictionaries(x), book) == direct).all()


# new cases of earlier operators


def test_empty_redelivery_clears_the_batch(spark, tmp_path):
    counts = spark.createDataFrame([("a", "en", "v", 5), (None, None, None, 2)], "source string, lang string, tokenizer string, n_tokens long")
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    rollup.commit("1", token_counts.inserts(counts))
    rollup.commit("2", token_counts.inserts(counts.limit(1)))
    rollup.commit("1", token_counts.inserts(counts.limit(0)))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 1, 5)]
    rollup.commit("2", token_counts.inserts(counts.limit(0)))
    assert rollup.totals().count() == 0


def test_overlaps_in_a_long_repetitive_text(spark):
    docs = write_table(spark.createDataFrame([(7, "word " * 20_000), (8, "other " * 50 + "word " * 15)], "doc_id long, text string"))
    items = write_table(spark.createDataFrame([(1, "word " * 15)], "item_id long, text string"))
    assert sorted(tuple(r) for r in decontamination.overlaps(docs, items).collect()) == [(7, 1, 0, 15, 15), (8, 1, 50, 15, 15)]


def test_pipeline_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["score", "predicted", "n_hits", "topic", "tokens", "rate", "item", "k1", "at", "d", "w", "weight"]
    clash = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, kept = stage(spark, docs, SF), stage(spark, clash, SF)
        assert kept.columns == clash.columns, name
        assert {r.doc_id for r in plain.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in kept.collect() for c in names), name
