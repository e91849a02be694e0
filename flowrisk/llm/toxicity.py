"""Toxicity by a weighted lexicon of word stems, found with Aho-Corasick in folded text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that stand in for a letter. i, l, 1, ! and | share one class.
LOOKALIKES = {
    "a": "4@аαạａ", "b": "8ьЬβｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "3еєεｅ", "f": "ｆ", "g": "9ɡｇ", "h": "һｈ",
    "i": "1!|lіιıɩӏⅰⅼｉｌ", "j": "јｊ", "k": "кκｋ", "m": "мｍ", "n": "ոηｎ", "o": "0оοσөｏ", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ",
    "s": "5$ѕｓ", "t": "7тτｔ", "u": "υսｕ", "v": "ѵνｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγүｙ", "z": "ᴢｚ",
}
#: Phrases in which a stem means no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown")
#: Stems have STEM letters. They are learnt from at most SAMPLE labelled rows, those with the smallest
#: hashes of their key; in each class of the sample every word counts once per document.
STEM = (4, 8)
SAMPLE = 20_000
#: A stem is taken if it is this much (log ratio of rates, G statistic) more frequent in toxic documents; it
#: must hold for the documents and, as copies repeat whole sentences, for the different words before the stem.
LOG_RATIO, EVIDENCE = 2.5, 30.0


def _folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalnum()}
    for letter, others in LOOKALIKES.items():
        table.update({ord(c): letter for c in others})
    table.update({c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)})
    return table


FOLDING = _folding()


def fold(text: str) -> str:
    """Lower case, look-alikes and digits as letters, invisible characters gone, punctuation as spaces."""
    return text.lower().translate(FOLDING)


@dataclass
class Lexicon:
    """Weights of folded stems, and how the normalised sum of their hits turns into a probability."""

    weights: dict[str, float]
    bias: float = -3.0
    slope: float = 3.0
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        """Stems match at the start of a word; exception phrases as whole phrases."""
        found = ahocorasick.Automaton()
        for stem, weight in self.weights.items():
            found.add_word(" " + stem, (weight, len(stem)))
        for phrase in self.exceptions:
            folded = fold(phrase)
            found.add_word(" " + folded, (found.get(" " + folded, (0.0, 0))[0], -len(folded)))
        if len(found):
            found.make_automaton()
        return found

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * value, -30, 30)))


def hits(automaton, text: str) -> tuple[float, int, int]:
    """Sum of weights and number of the hits outside exception phrases, and number of words."""
    folded = " " + fold(text) + " "
    n = len(folded.split())
    if not len(automaton):
        return 0.0, 0, n
    found, excused = [], []
    for end, (weight, size) in automaton.iter(folded):
        if size < 0:
            if not folded[end + 1].isalnum():
                excused.append((end + size + 1, end))
        else:
            found.append((end - size + 1, weight))
    own = [w for at, w in found if not any(a <= at <= b for a, b in excused)]
    return float(sum(own)), len(own), n


def normalised(weight, words):
    """Weight of the hits against the length of the text."""
    return weight / np.log(math.e + words)


def scores(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (``text`` may be one) with ``score``, ``predicted`` (score of at least a half) and ``n_hits``.

    Every whole ``text`` is read; null and empty texts have no hits and get the score of such texts.
    Repeated rows and null keys are scored like any other row. Columns of these three names are replaced.
    """

    keep = [c for c in keep if c.lower() not in ("score", "predicted", "n_hits")]
    columns = keep if "text" in keep else [*keep, "text"]
    at = columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [hits(automaton, t or "") for t in batch.column(at).to_pylist()]
            weight, count, words = (np.array(c) for c in zip(*found, strict=True)) if found else [np.zeros(0)] * 3
            p = lexicon.probability(normalised(weight, words))
            own = [pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(count.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *own], names=[*keep, "score", "predicted", "n_hits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*columns).mapInArrow(score, f"{schema}, score double, predicted int, n_hits long")


def sampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """``text`` and ``toxic`` of at most ``sample`` labelled training rows, chosen by hash of the key."""
    rows = labels.filter("toxic is not null").select(F.col(key).alias("k"), "toxic")
    rows = rows.filter(~held_out("k")).orderBy(F.xxhash64("k"), "toxic").limit(sample)
    return docs.select(F.col(key).alias("k"), "text").join(F.broadcast(rows), "k").select("text", "toxic")


def held_out(key: str):
    """Rows kept back from training: crc32 of the key's text is divisible by 5."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low, high = STEM
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[int(toxic > 0)].update({w[:k] for w in set(fold(text or "").split()) for k in range(low, min(len(w), high) + 1)})
    stems = list(counts[1])  # a stem without a toxic document is never taken
    columns = [pa.array(stems), pa.array([counts[1][s] for s in stems]), pa.array([counts[0][s] for s in stems])]
    if stems:
        yield pa.RecordBatch.from_arrays(columns, names=["stem", "toxic", "clean"])
    rest = [s for s in counts[0] if s not in counts[1]]
    for i in range(0, len(rest), 100_000):
        some = rest[i : i + 100_000]
        columns = [pa.array(some), pa.array([0] * len(some)), pa.array([counts[0][s] for s in some])]
        yield pa.RecordBatch.from_arrays(columns, names=["stem", "toxic", "clean"])


def _contexts(stems: list[str]):
    """The words that stand before the given stems."""
    wanted = set(stems)
    low, high = STEM

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = ""
                for word in fold(text or "").split():
                    for k in range(low, min(len(word), high) + 1):
                        if word[:k] in wanted:
                            found.add((word[:k], before, int(toxic > 0)))
                    before = word
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["stem", "before", "toxic"])

    return collect


def _telling(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """The stems whose counts in toxic (t) and clean (c) text differ enough, with the log ratio of their rates."""
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    share, both = toxic / (toxic + clean), F.col("t") + F.col("c")

    def part(n, p):
        return F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0)

    evidence = 2 * (part(F.col("t"), share) + part(F.col("c"), 1 - share))
    return counts.withColumn("ratio", ratio).filter((ratio >= LOG_RATIO) & (evidence >= EVIDENCE))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from labelled rows that are not held out; keys, languages and sources are not looked at.

    Of nested stems the shortest sufficient one is taken. The lexicon is bounded by the sample. Without toxic or
    without clean rows it is empty. Labels of null count as no label.
    """
    train = sampled(docs, labels, key, sample)
    totals = {r["t"]: r["n"] for r in train.groupBy((F.col("toxic") > 0).cast("int").alias("t")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, exceptions=exceptions)
    counts = train.mapInArrow(_stem_counts, "stem string, toxic long, clean long")
    counts = counts.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    candidates = [r[0] for r in _telling(counts, toxic, clean).select("stem").collect()]
    contexts = train.mapInArrow(_contexts(candidates), "stem string, before string, toxic int").distinct()
    own = [F.sum(F.col("toxic")).alias("t"), F.sum(1 - F.col("toxic")).alias("c")]
    taken = _telling(contexts.groupBy("stem").agg(*own), toxic, clean).select("stem", "ratio").collect()
    weights: dict[str, float] = {}
    for stem, w in sorted(taken, key=lambda r: (len(r[0]), r[0])):
        if not any(stem[:k] in weights for k in range(STEM[0], len(stem))):
            weights[stem] = float(w)
    lexicon = Lexicon(weights, exceptions=exceptions)
    return fitted(lexicon, scores(train, _Sum(weights, exceptions=exceptions), ["toxic"]))


class _Sum(Lexicon):
    """Shows the normalised sum itself as the score."""

    def probability(self, value: np.ndarray) -> np.ndarray:
        return value


def fitted(lexicon: Lexicon, values: DataFrame, rounds: int = 25) -> Lexicon:
    """Bias and slope by Newton's method with a weak ridge, on sums over equal values (rounded) of the sample."""
    rows = values.groupBy(F.round("score", 2).alias("x"), (F.col("toxic") > 0).cast("int").alias("y")).count().collect()
    x, y, n = (np.array([r[i] for r in rows], float) for i in range(3))
    beta = np.array([0.0, 1.0])
    design = np.stack([np.ones_like(x), x], axis=1)

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + 0.025 * (b @ b))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 0.05 * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        while loss(beta + move) > loss(beta) and np.abs(move).max() > 1e-9:
            move = move / 2
        beta = beta + move
    return Lexicon(lexicon.weights, float(beta[0]), float(beta[1]), lexicon.exceptions)
