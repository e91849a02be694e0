"""Token ids of whole texts by a public tokenizer file, inside Spark tasks."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flowrisk.llm.common import ranges, worker_store

#: Strings an encoder remembers; bounds its memory to about 200 MB. Others are encoded again in each call.
REMEMBERED = 700_000
#: A word of Latin letters and what may follow it without joining its letters.
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: Words handed to the library's model at once.
TOGETHER = 500
#: Words whose ids are listed at once; bounds the memory of their positions.
CHUNK = 1 << 18


def _byte_letters() -> dict[str, str]:
    """How byte-level vocabularies spell the plain non-ASCII letters: each byte above 0xA0 stands for its own code point."""
    spelt: dict[str, str] = {}
    others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    for c in range(0xDF, 0x100):
        spelt[chr(c)] = "".join(chr(256 + others.index(b)) if b in others else chr(b) for b in chr(c).encode())
    return spelt


class WordEncoder:
    """Encodes with a lower-casing tokenizer that drops white space and never merges across it.

    For such a tokenizer (``word_bpe_49k``) the ids of a text are those of its words in a
    row. Equal words are encoded once per call: a plain word as its letters in lower case and the marks
    after them, others as they are. Each such string is encoded once per worker as long as it is remembered;
    letters go to the library's model directly, all others through the whole tokenizer.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.spelt = _byte_letters()
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.places: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _spelt(self, text: str) -> str:
        if not text.isascii():
            for letter, spelt in self.spelt.items():  # no letter is part of another's spelling
                text = text.replace(letter, spelt)
        return text

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters in a row, and their numbers of ids: a word ends with the id that has the suffix."""
        joined = (self._spelt(" ".join(words[a : a + TOGETHER])) for a in range(0, len(words), TOGETHER))
        coded = (self.model.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in joined)
        ids = np.fromiter(chain.from_iterable(coded), np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):  # a model without suffixes
            each = [[t.id for t in self.tokenizer.model.tokenize(self._spelt(w))] for w in words]
            return np.fromiter(chain.from_iterable(each), np.uint32), np.array([len(x) for x in each], np.int64)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, new: list[str]) -> None:
        """Gives every new string the next place."""
        plain: list[str] = []
        others: list[str] = []
        for w in new:
            letters = w.islower() and w.isalpha() if w.isascii() else LETTERS.fullmatch(w)
            (plain if letters else others).append(w)
        ids, sizes = self._letters(plain)
        rest = [self._whole(w) for w in others]
        self.places.update(zip(plain + others, range(len(self.places), len(self.places) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, ids, np.fromiter(chain.from_iterable(rest), np.uint32)])
        sizes = np.append(sizes, np.array([len(x) for x in rest], np.int64))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        own = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        words = own.flatten().dictionary_encode()
        parts = pc.extract_regex(words.dictionary, PLAIN)
        letters, marks = (pc.struct_field(parts, n) for n in ("letters", "marks"))
        plain = pc.and_(pc.is_valid(parts), pc.invert(pc.fill_null(pc.match_substring(marks, "<|"), True)))
        columns = [
            pc.if_else(plain, pc.utf8_lower(letters), words.dictionary).dictionary_encode(),
            pc.if_else(plain, marks, "").dictionary_encode(),
        ]
        held = [c.dictionary.to_numpy(zero_copy_only=False).tolist() for c in columns]
        known, before = len(self.places), (self.flat, self.ends)
        new = [w for w in dict.fromkeys(chain(*held)) if w not in self.places]
        self._learn(new)
        flat, ends = self.flat, self.ends
        places = [
            np.fromiter(map(self.places.__getitem__, h), np.int64, len(h))[c.indices.to_numpy()] for h, c in zip(held, columns, strict=True)
        ]
        if known + len(new) > REMEMBERED:
            self.flat, self.ends = before
            for w in new:
                del self.places[w]
        both = np.stack(places, axis=1).ravel()
        starts, sizes = ends[both], ends[both + 1] - ends[both]
        flat, sizes = flat[ranges(starts, sizes)], sizes.reshape(-1, 2).sum(axis=1)
        word = words.indices.to_numpy()
        lengths = sizes[word]
        edges = np.append(0, np.cumsum(lengths))[own.offsets.to_numpy()]
        starts = np.cumsum(sizes) - sizes
        pieces = [flat[ranges(starts[word[a : a + CHUNK]], lengths[a : a + CHUNK])] for a in range(0, len(word), CHUNK)]
        return np.concatenate([flat[:0], *pieces]), np.diff(edges)


class TextEncoder:
    """Encodes whole texts with any tokenizer file."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
        counts = np.array([len(x) for x in ids], np.int64)
        return np.concatenate([np.array(x, np.uint32) for x in ids]) if ids else np.zeros(0, np.uint32), counts


def encoder(file: str, by_word: bool):
    """The worker's encoder for a tokenizer file."""
    store = worker_store("encoders")
    if (file, by_word) not in store:
        store[file, by_word] = (WordEncoder if by_word else TextEncoder)(file)
    return store[file, by_word]
