"""The training-data operators against brute force on small fixtures: hostile rows, ties, copies, empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from flowrisk.llm import coder, decontamination, html_text, mixing, near_text, near_vectors, sharding, suffix_dedup, token_counts, token_files, toxicity
from flowrisk.llm.linking import components
from flowrisk.llm.tokens import TextEncoder, WordEncoder

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Columns whose names the operators use inside.
CLASH = "key string, rep string, member string, item string, tokens string, score string, part string, mark string, k1 string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "élan", "zwölf", "the", "of", "x1", "don't", "###"]
    out = []
    base = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(6)]
    for i in range(60):
        words = list(rng.choice(base)) if i % 2 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 4)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, " ".join(words), "en" if i % 3 else None, f"s{i % 4}"))
    out += [(100, None, "en", None), (101, "", "de", "s1"), (102, " \n\t ", "de", "s1"), (103, "aaaa " * 20_000, "de", "s1")]
    out += [(104, out[5][1], "en", "s0"), (105, out[5][1], "en", "s0"), (106, "b" * 300, "fr", "s2"), (106, "b" * 300, "fr", "s2")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for field in CLASH.split(", "):
        plain = plain.withColumn(field.split()[0], F.lit("clash"))
    return plain.repartition(5)


@pytest.fixture(scope="module")
def with_null(docs):
    return docs.unionByName(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false")


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, width=5):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def connected(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


# token counts


def test_word_encoder_equals_library():
    texts = ["", "The quick. L'ÉTÉ Don't IT'S x's ñ### <|endoftext|> a<|startoftext|>b 日本語ok, ١٢ ΣΑΣ ﬁ µm é.", "a b c", "É!\nß…“x”"]
    texts += [" ".join(random.Random(i).choices("Ab,cÖé1'#$% \n", k=80)) for i in range(50)]
    raw = [t.encode() for t in texts]
    own, whole = WordEncoder(WORDS).encode(raw), TextEncoder(WORDS).encode(raw)
    assert own[0].tolist() == whole[0].tolist() and own[1].tolist() == whole[1].tolist()


def test_word_encoder_encodes_variants_once():
    """Case and marks make no new words: letters go to the library once, whatever follows them."""
    texts = ["Été the, THE.\x0bThe\x0c(the) the\x1cthe \u0130the İ ", "", " \t", "the\u00a0the ÉTÉ! été <|x|> the<| the<|endoftext|>"]
    words = WordEncoder(WORDS)
    raw = [t.encode() for t in texts]
    own, whole = words.encode(raw), TextEncoder(WORDS).encode(raw)
    assert own[0].tolist() == whole[0].tolist() and own[1].tolist() == whole[1].tolist()
    assert {"été", "the"} <= set(words.places) and not {"the,", "THE.", "The", "ÉTÉ!", b"The", b"THE.", b"the,"} & set(words.places)


def test_rollup_is_idempotent_and_additive(spark, docs, tmp_path, rows):
    counted = token_counts.token_counts(docs, WORDS, ["doc_id", "source", "lang"], by_word=True).withColumn("tokenizer", F.lit("v1"))
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    rollup.commit("a", token_counts.inserts(counted))
    gone = counted.filter("doc_id >= 100")
    for _ in range(2):
        rollup.commit("b", token_counts.deletes(gone))
    rollup.commit("c", token_counts.revisions(counted.filter("doc_id < 10"), counted.filter("doc_id < 10").withColumn("tokenizer", F.lit("v2"))))
    rollup.commit("d", token_counts.inserts(counted.limit(0)))
    enc = TextEncoder(WORDS)
    true = defaultdict(lambda: [0, 0])
    for i, text, lang, source in rows:
        if i < 100:
            cell = true[source, lang, "v2" if i < 10 else "v1"]
            cell[0] += 1
            cell[1] += int(enc.encode([(text or "").encode()])[1][0])
    assert {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in rollup.totals().collect()} == dict(true)


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 40, 1000, 4097])
def test_permutation_and_inverse(n):
    p = sharding.Permutation(n, 5)
    there = p.forward(np.arange(n))
    assert sorted(there) == list(range(n)) and (p.backward(there) == np.arange(n)).all()


def test_shards(spark, with_null, nothing, rows):
    out = sharding.shard(with_null.drop("text"), ["doc_id", "lang", "source"], 7, 3)
    got = out.collect()
    assert sorted(r.row_number for r in got) == list(range(len(rows) + 1))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert sharding.locate(r.row_number, len(got), 7, 3) == (r.shard, r.slot)
        assert sharding.row_at(r.shard, r.slot, len(got), 7, 3) == r.row_number
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(with_null.drop("text").repartition(3), ["doc_id", "lang", "source"], 7, 3).collect()
    assert Counter((r.doc_id, r.lang, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.lang, r.shard, r.slot) for r in got)
    assert sharding.shard(nothing, ["doc_id"], 7).count() == 0


# decontamination


def test_overlaps(spark, with_null, docs, nothing):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    changed = item.replace("three", "drei").replace("nine", "neun")
    far = " ".join(w if i % 2 else "q" for i, w in enumerate(item.split()))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item"), (5, "..."), (None, item)], "item_id long, text string")
    more = [(200, "x " + item.upper() + "!"), (201, "y y y " + changed + " z"), (202, far), (203, "some tiny, item here"), (204, "one two three"), (None, item)]
    both = with_null.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = {(r.doc_id, r.item_id, r.at, r.matched, r.item_words) for r in decontamination.overlaps(both, bench).collect()}
    assert got == {(d, i, a, m, n) for d, a, m in ((200, 1, 15), (201, 3, 13), (None, 0, 15)) for i in (1, None) for n in [15]} - {
        (d, None, a, m, 15) for d, a, m in ((200, 1, 15), (201, 3, 13), (None, 0, 15))
    } | {(203, 4, 1, 2, 2)}
    kept = {r.doc_id for r in decontamination.decontaminated(both, bench).collect()}
    assert kept & {200, 201, 203} == set() and {202, 204, None, 5} <= kept
    assert decontamination.overlaps(nothing, bench).count() == 0
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0


# toxicity


def test_hits_fold_and_excuse():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot"): 4.0, toxicity.fold("trash"): 3.0})
    found = lexicon.automaton()
    assert [toxicity.hits(found, t)[1] for t in ("1d10t!", "іdіоt.", "IDIOTS", "an idiotic", "xidiot", "trash can", "trash canned", "", "i​diot")] == [
        1, 1, 1, 1, 0, 0, 1, 0, 1,
    ]
    assert toxicity.hits(toxicity.Lexicon({}, exceptions=()).automaton(), "a b")[:2] == (0.0, 0)


def test_learnt_scores(spark, with_null, nothing):
    rng = random.Random(1)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    made, labels = [], []
    for i in range(600):
        words = rng.choices(clean, k=rng.choice([5, 60]))
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["wretch", "w4etch", "WRETCHED"]).replace("4", "r")
        made.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    table = spark.createDataFrame(made, "doc_id long, text string").unionByName(with_null.withColumn("doc_id", F.col("doc_id") + 10_000), allowMissingColumns=True)
    label_rows = spark.createDataFrame(labels + [(601, None), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(table, label_rows)
    assert list(lexicon.weights) == ["wret"]
    got = toxicity.scores(table, lexicon, ["doc_id"]).withColumn("h", toxicity.held_out("doc_id")).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.h for r in got if r.doc_id is not None)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 600)
    assert toxicity.scores(nothing, lexicon, ["doc_id"]).count() == 0
    assert toxicity.learn(nothing, label_rows).weights == {}


# token files


@pytest.mark.parametrize("n", [1, 2, coder.BLOCK, coder.BLOCK + 1, 3 * coder.BLOCK + 7])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.zeros(n, int), rng.integers(0, 3, n), np.full(n, 65535), rng.integers(0, 1 << 22, n)):
        bits = coder.id_bits(ids.max())
        prior = coder.Prior.of(ids)
        payloads = coder.encode_blocks(ids, bits, prior)
        lengths = np.array([min(coder.BLOCK, n - a) for a in range(0, n, coder.BLOCK)])
        assert (np.concatenate(coder.decode_blocks(payloads, lengths, bits, prior)) == ids).all()
    assert sum(map(len, coder.encode_blocks(np.zeros(n, int), 16, coder.Prior.of(np.zeros(n, int))))) < 60 + n // 20


def test_coder_escapes_rare_ids(monkeypatch):
    monkeypatch.setattr(coder, "MOST", 10)
    ids = np.random.default_rng(3).geometric(0.05, 5000) * 977
    prior = coder.Prior.of(ids)
    assert len(coder.Prior(prior).own) == 11
    for bits in (coder.id_bits(ids.max()), 30):
        payloads = coder.encode_blocks(ids, bits, prior)
        lengths = np.array([coder.BLOCK, coder.BLOCK, 5000 - 2 * coder.BLOCK])
        assert (np.concatenate(coder.decode_blocks(payloads, lengths, bits, prior)) == ids).all()


def test_coder_beats_the_entropy_of_single_ids():
    """Texts of words of two ids each: the second id follows from the first, so few bits are left for it."""
    rng = np.random.default_rng(5)
    first = rng.zipf(1.4, 60_000) % 400
    ids = np.stack([first, 1000 + first % 40], axis=1).ravel()
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    prior = coder.Prior.of(ids)
    size = len(prior) + sum(map(len, coder.encode_blocks(ids, coder.id_bits(ids.max()), prior)))
    assert 8 * size / len(ids) < 0.85 * entropy


def test_coder_knows_contexts_of_other_blocks():
    """Words of two ids, most of them once in a block: what follows the first id is known from other blocks."""
    first = np.random.default_rng(6).integers(0, 4000, 100_000)
    ids = np.stack([first, 4000 + first * 7 % 4000], axis=1).ravel()
    prior = coder.Prior.of(ids)
    payloads = coder.encode_blocks(ids, coder.id_bits(ids.max()), prior)
    assert 8 * sum(map(len, payloads)) / len(ids) < 0.62 * np.log2(8000)
    lengths = np.array([min(coder.BLOCK, len(ids) - a) for a in range(0, len(ids), coder.BLOCK)])
    assert (np.concatenate(coder.decode_blocks(payloads, lengths, coder.id_bits(ids.max()), prior)) == ids).all()


def test_crc_joins():
    a, b, c = b"spark", b"", b"x" * 1000
    assert token_files.crc32_joined([zlib.crc32(x) for x in (a, b, c)], [5, 0, 1000]) == zlib.crc32(a + b + c)


def test_token_files(spark, with_null, nothing, rows, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write(with_null, path, WORDS, 2, by_word=True)
    enc = TextEncoder(WORDS)
    null_text = next(t for i, t, *_ in rows if i == 3)
    ordered = [(None, null_text), *sorted(((i, t) for i, t, *_ in rows), key=lambda r: r[0])]
    start, true, ids_of = 0, Counter(), {}
    for i, t in ordered:
        ids = [*enc.encode([(t or "").encode()])[0].tolist(), 2]
        true[i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        ids_of[i] = ids
        start += len(ids)
    assert Counter(tuple(r) for r in token_files.read_digests(spark, path).collect()) == true
    assert all(ids_of[r.key] == r.ids for r in token_files.read_ids(spark, path).collect())
    damaged = spark.read.schema(token_files.SCHEMA).parquet(path).withColumn("payload_crc32", F.lit(1).cast("long"))
    damaged.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="damaged"):
        token_files.read_digests(spark, str(tmp_path / "bad")).collect()
    token_files.write(nothing, str(tmp_path / "none"), WORDS, 2)
    assert token_files.read_digests(spark, str(tmp_path / "none")).count() == 0


# suffix arrays


def removed_by_hand(pairs, length, first):
    raw = [(t or "").encode() for _, t in pairs]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    had, out = set(), {}
    for (k, _), r in sorted(zip(pairs, raw, strict=True), key=lambda x: x[0][0]):
        mask = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            w = r[i : i + length]
            if (w in had) if first else seen[w] > 1:
                mask[i : i + length] = True
            had.add(w)
        n = int((np.diff(np.append(0, mask.astype(int))) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~mask])
        out[k] = (len(r), int(mask.sum()), n, hashlib.sha256(kept).hexdigest())
    return out


def test_previous_factors_by_hand():
    text = b"abracadabra-abracadabra"
    starts = np.arange(len(text) - 7)
    got = suffix_dedup.previous_factors(np.frombuffer(text, np.uint8), starts, starts, 8)
    assert [bool(g >= 8) for g in got] == [any(text[i : i + 8] == text[j : j + 8] for j in range(i)) for i in starts]


@pytest.mark.parametrize(("length", "gram", "hot", "first"), [(20, 8, 4096, False), (20, 8, 4096, True), (24, 10, 1, False), (24, 10, 1, True), (200, 32, 4096, False)])
def test_repeats(docs, rows, length, gram, hot, first):
    unique = docs.filter("doc_id <> 106 and doc_id <> 103").unionByName(docs.filter("doc_id = 106").limit(1))
    pairs = [(i, t) for i, t, *_ in rows[:-1] if i != 103]
    got = suffix_dedup.digest(suffix_dedup.without_repeats(unique, length=length, keep_first=first, gram=gram, hot=hot)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == removed_by_hand(pairs, length, first)


def test_repeats_hostile_rows(with_null, nothing):
    got = suffix_dedup.digest(suffix_dedup.without_repeats(with_null, keep_first=False)).collect()
    assert len(got) == with_null.count()
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (106, 103, 100)} == {106: 300, 103: 100_000, 100: 0}
    assert suffix_dedup.without_repeats(nothing).count() == 0


# html


@pytest.fixture(scope="module")
def field():
    return html_text.train(html_text.training_set())


def test_field_on_unseen_pages(field):
    pages = html_text.training_set(100, seed=99)
    wrong = sum(a != b for page, labels in pages for a, b in zip(field.decode(page), labels, strict=True))
    assert wrong < 0.01 * sum(len(labels) for _, labels in pages)


def test_viterbi_is_the_best_labelling(field):
    page = html_text.training_set(1, seed=5)[0][0][:9]

    def value(labels):
        own = sum(field.weights.get(n, (0, 0))[y] for names, y in zip(page, labels, strict=True) for n in names)
        return own + sum(field.steps[a][b] for a, b in zip(labels[:-1], labels[1:], strict=True))

    every = [[(k >> i) & 1 for i in range(len(page))] for k in range(1 << len(page))]
    assert value(field.decode(page)) == pytest.approx(max(map(value, every)))


def test_main_text(spark, field):
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        "<div class=ad>Buy now.</div><article><h1>Head &amp; line</h1><p><b>First\n  bold&nbsp;words here.<br><p>Second &lt;one&gt; with &am"
        "</article><div class=comments><p>I disagree with it all.</p></div><footer>&copy; site</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<![foo <p"), (None, "u", page), (1, "u", page), (5, "u", "<p>" * 50 + "x" * 100_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(table, field, ["page_id", "url", "text"]).collect()
    text = "Head & line\nFirst bold words here.\nSecond <one> with &am"
    assert sorted((str(r.page_id), r.n_chars) for r in got if r.text == text) == [("1", len(text)), ("1", len(text)), ("None", len(text))]
    assert {r.page_id: r.text for r in got if r.page_id in (2, 3)} == {2: "", 3: ""} and len(got) == len(rows)
    assert html_text.extract(table.limit(0), field, ["page_id"]).count() == 0


# near-duplicate texts


def test_near_texts(spark, docs, with_null, nothing, rows):
    how = near_text.Settings(percent=50, side=24, rows=3)
    ids = sorted({i for i, *_ in rows})
    text = {i: t for i, t, *_ in rows}
    sets = {i: shingles(text[i]) for i in ids}
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 50 * len(sets[a] | sets[b])]
    true = connected(ids, linked)
    got = near_text.near_duplicates(docs, how=how).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), true[i], true[i] == i) for i in ids}
    null = [r for r in near_text.near_duplicates(with_null, how=how).collect() if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in null] == [(None, True)]
    assert near_text.near_duplicates(nothing).count() == 0
    assert {r.doc_id for r in near_text.deduplicated(docs, how=how).collect()} == {i for i in ids if true[i] == i}


def test_tiles_cover_each_pair_once():
    sets = [np.array(sorted({i, i + 1, i + 2, 99}), np.uint64) for i in range(0, 12)]
    members = np.arange(12)
    u, v = near_text.links_of_tile(members, sets, np.zeros(12, int), 60)
    assert connected(range(12), zip(u, v, strict=True)) == dict.fromkeys(range(12), 0)
    u, v = near_text.links_of_tile(members, sets, (members >= 6).astype(int), 60)
    assert {tuple(sorted(x)) for x in zip(u.tolist(), v.tolist(), strict=True)} == {(5, 6)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == connected({n for e in edges[:-1] for n in e}, edges[:-1])


# mixing


def test_raked_shares_meet_targets(spark):
    cells = spark.createDataFrame([(a, b, 10 * (i + 1)) for i, (a, b) in enumerate((a, b) for a in ("x", "y", None) for b in ("p", "q"))], "source string, lang string, tokens long")
    goal = {"source": [("x", 0.5), ("y", 0.3), (None, 0.2)], "lang": [("p", 0.6), ("q", 0.4)]}
    targets = {d: spark.createDataFrame(v, f"{d} string, share double") for d, v in goal.items()}
    got = mixing.rake(cells, targets).collect()
    for d, want in goal.items():
        sums = defaultdict(float)
        for r in got:
            sums[r[d]] += r.weight
        assert dict(sums) == pytest.approx(dict(want), abs=1e-8)
    odds = {(r.source, r.lang): r.weight / r.tokens for r in got}
    assert odds["x", "p"] * odds["y", "q"] == pytest.approx(odds["x", "q"] * odds["y", "p"])  # raking keeps odds ratios


def test_mixed_sample(with_null, nothing):
    got = mixing.mixed(with_null).collect()
    assert all(0 < r.rate <= 1 + 1e-12 for r in got) and max(r.rate for r in got) == pytest.approx(1)
    assert {r.doc_id for r in mixing.mixed(with_null.repartition(2)).collect()} == {r.doc_id for r in got}
    for r in got:
        digest = hashlib.md5(f"9:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        assert int(digest[:12], 16) / 2**48 < r.rate
    assert mixing.mixed(nothing).count() == 0


def test_rare_source_does_not_empty_the_sample(spark):
    size = {"web": 5000, "books": 2000, "code": 900, None: 60}
    rows = [(s, lang, 10 * n // (1 + k)) for s, n in size.items() for k, lang in enumerate(("en", "de", "fr"))]
    rare, alone = ("typo", "en", 3), ("typo", "xx", 1)
    found = {}
    for name, more in (("plain", []), ("rare", [rare, alone])):
        cells = spark.createDataFrame(rows + more, "source string, lang string, tokens long")
        targets = {d: mixing.tempered(cells, d, p) for d, p in (("source", 0.7), ("lang", 0.8))}
        goal = {d: {r[d]: r.share for r in t.collect()} for d, t in targets.items()}
        got = {(r.source, r.lang): (r.weight, r.tokens) for r in mixing.rake_within(cells, targets, 0.75).collect()}
        total = sum(n for _, n in got.values())
        assert sum(w for w, _ in got.values()) == pytest.approx(0.75 * total) and all(0 < w <= n for w, n in got.values())
        found[name] = {k: w / n for k, (w, n) in got.items()}
        for at, d in enumerate(("source", "lang")):  # values with no whole cell keep the proportions of their targets
            have = {v: sum(w for k, (w, _) in got.items() if k[at] == v) for v in goal[d]}
            open_values = [v for v in goal[d] if any(w < n for k, (w, n) in got.items() if k[at] == v)]
            scale = {v: have[v] / goal[d][v] for v in open_values}
            assert max(scale.values()) == pytest.approx(min(scale.values()), rel=1e-2)
    assert found["rare"]["typo", "en"] == found["rare"]["typo", "xx"] == 1
    assert all(found["rare"][k] == pytest.approx(r, abs=0.005) for k, r in found["plain"].items())


def test_mixing_stage_keeps_its_share(spark):
    text = F.concat_ws(" ", F.sequence(F.lit(1), F.lit(9) + F.col("id") % 20))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") == 7, "typo").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("source"))
    kept = corpus_pipeline.mixed(spark, docs, SF)
    n = mixing.tokens(F.col("text"))
    share = kept.agg(F.sum(n)).first()[0] / docs.agg(F.sum(n)).first()[0]
    assert kept.columns == docs.columns and abs(share - 0.75) < 0.02 and kept.filter("source = 'typo'").count() == 1
    assert mixing.mixed(docs, keep=1.0).count() == 20_000
    assert mixing.mixed(docs.limit(0), keep=0.75).count() == 0


# near-duplicate vectors


def test_lattice_points_are_nearest():
    x = np.random.default_rng(0).normal(size=(200, 8)) * 2
    point = near_vectors.nearest_point(x)
    distance = ((x - point) ** 2).sum(axis=1)
    for v in near_vectors.NEIGHBOURS:
        assert (((x - point - v) ** 2).sum(axis=1) >= distance - 1e-9).all()
    assert len(near_vectors.NEIGHBOURS) == 240


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 32))
    x = np.repeat(centre, 20, axis=0) + rng.normal(size=(240, 32)) * 0.13
    rows = [(i, [float(np.float32(c)) for c in v], int(i % 2)) for i, v in enumerate(x)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, [2 * c for c in rows[0][1]], 0), (303, rows[0][1], None), (304, None, 0), (305, [], 0)]
    rows += [(306, [0.0] * 32, 0), (307, [float("nan")] * 32, 0), (308, [None] + [1.0] * 31, 0), (309, [float("inf")] * 32, 0), (310, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash")).repartition(4)
    usable = [r for r in rows[:243] if r[2] is not None]
    m = np.array([np.array(r[1], np.float32) for r in usable], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    label = np.array([r[2] for r in usable])
    close = (m @ m.T >= 0.98) & (label[:, None] == label[None, :])
    ids = [r[0] for r in usable]
    linked = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(close), strict=True) if i < j]
    true = connected(ids, linked)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(table).collect()}
    assert {k: got[k] for k in ids} == {k: (int(close[i].sum()) - 1, true[k], true[k] == k) for i, k in enumerate(ids)}
    assert len(linked) > 300 and all(got[k] == (0, k, True) for k in range(303, 311)) and got[None] == (0, None, True)
    assert near_vectors.near_duplicates(table.limit(0)).count() == 0


# pipeline


def near_copies(first, n, rng):
    """Documents in pairs, the second a copy of 103 words with so many words replaced that 80 to 85 in 100 shingles agree (80 exactly for some), or just fewer."""
    out, share = [], {}
    for k in range(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(103)]
        copy = list(base)
        for at in ((50, 99), (50, 94), (50, 94, 102), (50, 94, 101))[k % 4]:
            copy[at] = "other"
        a, b = shingles(" ".join(base)), shingles(" ".join(copy))
        share[first + 2 * k] = len(a & b) / len(a | b)
        out += [(first + 2 * k, " ".join(base)), (first + 2 * k + 1, " ".join(copy))]
    return out, share


def test_near_duplicates_stage(spark):
    rows, share = near_copies(0, 200, random.Random(7))
    between = [i for i, s in share.items() if 0.8 <= s < 0.85]
    assert len(between) == 150 and min(share.values()) < 0.8 in share.values()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates_out(spark, docs, SF).collect()}
    assert kept == {i for i, _ in rows} - {i + 1 for i, s in share.items() if s >= 0.8}


def test_pipeline(spark, monkeypatch):
    kept = []

    def counted(stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            kept.append((docs, out.columns))
            return out

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, counted(f)) for n, f in corpus_pipeline.STAGES])
    last = queries()["pipeline"](spark, SF).collect()
    sizes = [docs.count() for docs, _ in kept]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] == 200 and len(last) == sizes[-1] > 0
    assert all(columns == kept[0][0].columns for _, columns in kept[:-1])
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in kept[-1][0].select("doc_id").collect())
