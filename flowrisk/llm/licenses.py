"""Licences named in texts, by a positional index of the rarest words of licence templates; DataFrame functions only."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")
#: Words that no match may span; what lies between them in a text is not looked at.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The only character besides A-Z whose lower case is one of a-z, and a letter that is none.
_KELVIN, _OTHER = "K", "é"
#: Index words of a template, all of which must agree in place before anything else is looked at.
RARE = 2
#: A template names its licence where its key phrases stand and so many of 100 of its words agree in place, each weighted by rarity.
MATCHED = 60


@dataclass(frozen=True)
class Template:
    """A licence notice: ``label``, its ``text`` and the phrases of it that must stand in place; no phrases: the whole text.

    Places of a ``base`` template are counted, located and reported apart.
    """

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    def words(self) -> list[str]:
        return WORD.findall(self.text)

    def key_places(self) -> list[int]:
        """Places of the words of all key phrases, each phrase at its first place in the text."""
        text, out = self.words(), set()
        for key in [WORD.findall(k) for k in self.keys] or [text]:
            at = next((i for i in range(len(text) - len(key) + 1) if text[i : i + len(key)] == key), None)
            if at is None or not key:
                raise ValueError(f"key phrase {' '.join(key)!r} is not part of the template {self.label}")
            out.update(range(at, at + len(key)))
        return sorted(out)


# The phrases of the contract, and public licence notices.
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)
NOTICES = (
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    Template("apache-2", "spdx license identifier apache 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("use in source and binary forms", "are permitted")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "licensed under cc0 1 0", ("cc0 1 0",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license as published by", "version 3 of the license")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("mit", "spdx license identifier mit"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("public-domain", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
TEMPLATES = BASE + NOTICES


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and characters beyond ASCII, A-Z lower-cased.

    ``lower`` also changes letters beyond ASCII, which neither splits nor joins words and cannot make them equal to an ASCII word.
    """
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit(_KELVIN), F.lit(_OTHER))), _BETWEEN), "")


def weights(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Weight by rarity of every template word: the bits of (documents / (documents with the word + 1)), so at least 0.

    One pass over all texts; a row per template word is all that reaches the driver.
    """
    vocabulary = sorted({w for t in templates for w in t.words()})
    text = F.coalesce("text", F.lit(""))
    known = F.array_intersect(words(text), F.array(*map(F.lit, vocabulary)))
    found = docs.select(F.explode(F.concat(known, F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()  # vocabulary size
    n = {r["word"]: r["count"] for r in found}
    return {w: (n.get("", 0) // (n.get(w, 0) + 1)).bit_length() for w in vocabulary}


def _index(templates: tuple[Template, ...], weight: dict[str, int]) -> list[dict]:
    """The templates as index entries: the rarest word of the key phrases, the checks in the order they are made, and the weighted postings."""
    out = []
    for number, t in enumerate(templates):
        text, keys = t.words(), t.key_places()
        if not text or not all(w.isascii() for w in text):
            raise ValueError(f"the template {t.label} needs words, all of them ASCII")
        rare = sorted(keys, key=lambda i: (-weight[text[i]], text[i], i))[:RARE]
        checks = rare[1:] + [i for i in keys if i not in rare]
        # A template all of whose words are everywhere is scored by plain word counts.
        own = [weight[w] for w in text] if any(weight[w] for w in text) else [1] * len(text)
        out.append({
            "template": number, "label": t.label, "base": t.base, "first": text[rare[0]], "off": rare[0], "whole": sum(own),
            "checks": [{"off": i, "word": text[i]} for i in checks],
            "postings": [{"off": i, "word": w, "weight": x} for i, (w, x) in enumerate(zip(text, own, strict=True)) if x],
        })
    return out


_ENTRY = (
    "array<struct<template: int, label: string, base: boolean, first: string, off: int, whole: int, "
    "checks: array<struct<off: int, word: string>>, postings: array<struct<off: int, word: string, weight: int>>>>"
)


def scanned(docs: DataFrame, weight: dict[str, int], key: list[str], templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``key`` columns, n_words, and ``places``: template number, label, base, start, matched and whole weight of every verified place.

    The index has the ``RARE`` rarest words among the key phrases of each template, with their places in it. A file looks up
    which of its words are in the index; a template is laid where its rare words agree in relative position, and stands
    where all its key phrases do. As every place of the phrases has their rare words in place, none is missed.
    """
    entries = _index(templates, weight)
    rarest = sorted({e["first"] for e in entries})
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*key, words(text).alias("__w"))
    w = F.col("__w")
    at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(rarest))
    none = F.array().cast("array<int>")
    rows = rows.withColumn("__at", F.when(F.arrays_overlap(w, F.array(*map(F.lit, rarest))), at).otherwise(none))

    def agrees(start: Column, c: Column) -> Column:
        return F.coalesce(F.get(w, start + c["off"]) == c["word"], F.lit(False))

    def starts(e: Column) -> Column:
        anchors = F.filter("__at", lambda i: F.get(w, i) == e["first"])
        return F.filter(F.transform(anchors, lambda i: i - e["off"]), lambda s: F.forall(e["checks"], lambda c: agrees(s, c)))

    def laid(e: Column) -> Column:
        return F.transform(starts(e), lambda s: F.struct(
            e["template"].alias("template"), e["label"].alias("label"), e["base"].alias("base"), s.cast("long").alias("start"),
            F.aggregate(e["postings"], F.lit(0), lambda a, c: a + F.when(agrees(s, c), c["weight"]).otherwise(0)).alias("matched"),
            e["whole"].alias("whole"),
        ))

    index = F.from_json(F.lit(json.dumps(entries)), _ENTRY)
    places = F.flatten(F.transform(F.when(F.size("__at") > 0, index).otherwise(F.slice(index, 1, 0)), laid))
    good = F.filter(places, lambda p: p["base"] | (p["matched"] * 100 >= p["whole"] * MATCHED))
    return rows.select(*key, F.size(w).cast("long").alias("n_words"), good.alias("places"))


def _labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def licenses(docs: DataFrame, key: str = "doc_id", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``key``, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    ``n_base`` counts the places of base templates, ``first_word`` and ``last_word`` are their smallest and largest start (null if there are none).
    ``labels`` has those of all templates that stand in the text; ``score`` is the largest weighted share of agreeing words of such a
    template, 0 without one. Null text is empty: no words, no labels (empty strings). Repeated rows and rows of null key each get their row;
    an empty table gives no rows. Only key and text are read, so other columns cannot clash. No row leaves its task: nothing is shuffled
    but the word statistics.
    """
    places = scanned(docs.select(key, "text"), weights(docs.select("text"), templates), [key], templates)
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    return places.select(
        key, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["matched"] / p["whole"])), F.lit(0.0)).alias("score"),
    )
