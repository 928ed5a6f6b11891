"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a run of texts are laid out as one array of symbols. An index maps
each rank (a pair that merges) to all positions where the pair stands. Active ranks are
applied in ascending order, each to all its positions at once; the pairs that arise next to
a merged symbol enter the lists of their own ranks. Words do not touch, so this gives what
merging word by word gives.

Rows: a null text is encoded as an empty one (no ids, empty decoded text). Repeated rows are
encoded each on their own, other columns pass through untouched, whatever their names: the
result is one struct column. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm.common import WORD_BPE, slices, vocabulary_path

#: Characters of text that are encoded together, and the distinct words kept between runs.
RUN_CHARS = 1_500_000
KEPT_WORDS = 120_000
#: Finds letters beyond the blocks whose tables have long been complete.
BEYOND_LATIN = regex.compile(r"[\u0530-\U0010FFFF]").search


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Codes(dict):
    """A number for each new key, in order of arrival."""

    def __missing__(self, key: str | tuple[str]) -> int:
        self[key] = code = len(self)
        return code


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = [""] * (1 + max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.base = len(self.tokens) + 1
        keys = self.left.astype(np.int64) * self.base + self.right
        self.rank_of = np.argsort(keys)
        self.keys = keys[self.rank_of]
        characters = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(characters)}
        self.path = path
        self.inner = np.array([vocab[c] for c in characters], np.int32)
        self.last = np.array([vocab[c + end] for c in characters], np.int32)
        self.forget()

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, for the few texts that need its tables."""
        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        """Drop the kept words."""
        self.codes = Codes()
        self.packed: list[bytes] = []

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges (negative symbols never do)."""
        keys = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.rank_of[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw])
        n = int(ends[-1])
        letters = np.frombuffer(b"".join(raw), np.uint8)
        # One place past the end stands for "no neighbour"; its symbol never merges.
        symbol = np.append(self.inner[letters], np.int32(-1))
        symbol[ends - 1] = self.last[letters[ends - 1]]
        after = np.arange(1, n + 2, dtype=np.int32)
        after[ends - 1] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[0] = n
        before[ends[:-1]] = n
        self._merge(symbol, after, before, n)
        alive = symbol[:n] >= 0
        ids = symbol[:n][alive].astype("<u4").tobytes()
        cuts = np.concatenate(([0], np.cumsum(alive)[ends - 1])) * 4
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _merge(self, symbol: np.ndarray, after: np.ndarray, before: np.ndarray, n: int) -> None:
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            found = np.flatnonzero(ranks >= 0)
            if not found.size:
                return
            found = found[np.argsort(ranks[found], kind="stable")]
            ranks, places = ranks[found], places[found]
            cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                rank = int(ranks[a])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(places[a:b])

        places = np.arange(n, dtype=np.int32)
        enter(self.ranks(symbol[:n], symbol[after[:n]]), places)
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, c = self.left[rank], self.right[rank], self.made[rank]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b and at.size > 1:
                at = np.unique(at)
                taken, free = [], -1
                for p, q in zip(at.tolist(), after[at].tolist()):
                    if p != free:  # the place was not used up by the pair to its left
                        taken.append(p)
                        free = q
                at = np.array(taken, np.int32)
            if not at.size:
                continue
            gone = after[at]
            following = after[gone]
            symbol[at] = c
            symbol[gone] = -2
            after[at] = following
            before[following] = at
            leading = before[at]
            places = np.concatenate((leading, at))
            enter(
                self.ranks(symbol[places], np.concatenate((symbol[at], symbol[following]))),
                places,
            )

    def split(self, text: str) -> list[str]:
        """Words of a text that holds no special token."""
        if BEYOND_LATIN(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            # The library may know letters that these tables do not have yet.
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in pieces]
        text = unicodedata.normalize("NFC", text)
        # Lower case letter by letter: str.lower treats a final sigma on its own.
        return self.words(text.lower() if "Σ" not in text else "".join(map(str.lower, text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.codes) > KEPT_WORDS:
            self.forget()
        code, rows = self.codes.__getitem__, []
        for text in texts:
            parts = self.marks.split(text) if self.marks and "<" in text else [text]
            words = self.split(parts[0])
            for mark, part in zip(parts[1::2], parts[2::2]):
                words.append((mark,))  # no word, so merged with nothing
                words += self.split(part)
            rows.append(array("i", map(code, words)))
        fresh = list(islice(self.codes, len(self.packed), None))
        plain = iter(self.encode_words([w for w in fresh if isinstance(w, str)]))
        self.packed += [
            next(plain) if isinstance(w, str) else self.special[w[0]].to_bytes(4, "little") for w in fresh
        ]
        packed = self.packed.__getitem__
        return [b"".join(map(packed, row)) for row in rows]

    def decode(self, packed: bytes) -> str:
        """Tokens joined by one space: the file names no decoder, so nothing is undone."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


@cache
def loaded(path: str) -> WordBpe:
    """The tokenizer, read once per worker."""
    return WordBpe(path)


def encoded(text: Column, path: str | None = None) -> Column:
    """struct<ids: binary, decoded: string> for each text.

    ``ids`` are little-endian unsigned 32-bit integers, as the tokenizers library gives them
    without added special tokens; ``decoded`` is its decode with special tokens kept.
    """
    path = path or vocabulary_path(WORD_BPE)

    @F.pandas_udf("struct<ids: binary, decoded: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loaded(path)
        for batch in batches:
            if not len(batch):
                yield pd.DataFrame({"ids": [], "decoded": []})
            for texts in slices(batch, RUN_CHARS):
                ids = model.encode(texts)
                yield pd.DataFrame({"ids": ids, "decoded": [model.decode(x) for x in ids]})

    return run(text)
