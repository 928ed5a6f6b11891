"""Benchmark decontamination with suffix arrays over the training text.

Each run of documents is a shard. A shard's words are numbered by the benchmark's
vocabulary, a word outside it ends a stretch, and the suffixes that are long enough to hold
a window are sorted by their leading words: the shard's suffix array. The windows of every
benchmark suffix are looked up in it by binary search, each distinct window once. A place
holds one window at most, so the places found are no more than the words of the shard, however
often a word or a passage repeats on either side. Windows at neighbouring places that follow
each other in an item join into its verbatim match there. Items that share a window share its
set of items, so a passage common to many of them is followed once. A document with a match is
contaminated.

A match is the longest verbatim one where an item holds each of its windows once. In an item
that repeats a window of its own, a match may pass from one occurrence to another: every word
of it and its neighbours are still verbatim, and the words hit are the same.

The benchmark is dealt into blocks of about ``BLOCK_BYTES`` of text by a hash of the text (an
item larger than that is in one block all the same). The window table of a block is made in a
task and written. One block at a time is sent to the tasks and searched in every document.

Rows: null text has no words; an item without words matches nothing; items of fewer words
than a window are one window. Equal items are searched once and all named. A null item_id
is named as the empty string. Repeated documents are judged each on their own. All other
columns pass through untouched, whatever their names; an empty benchmark leaves every
document clean, an empty documents table gives an empty one.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Numbered, covered, slices, stored

WINDOW = 10
BLOCK_BYTES = 8_000_000
SHARD_CHARS = 4_000_000
FOUND = "struct<n_words: bigint, matches: array<struct<start: int, end: int, item: string>>, items: array<string>>"

# Upper to lower case, every other ASCII character that is no letter or digit to a space.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: stretches of ASCII letters, digits and all characters beyond ASCII."""
    return text.encode("utf-8", "replace").translate(FOLD).split()


class ItemSets:
    """Sets of items by key, equal sets kept once."""

    def __init__(self):
        self.sets: list[frozenset[int]] = []
        self.number: dict[frozenset[int], int] = {}

    def numbers(self, keys: np.ndarray, items: np.ndarray, n_keys: int) -> np.ndarray:
        """For each key the number of the set of items that stand beside it."""
        order = np.lexsort((items, keys))
        keys, items = keys[order], items[order]
        cuts = np.searchsorted(keys, np.arange(n_keys + 1)).tolist()
        items = items.tolist()
        out = np.empty(n_keys, np.int64)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            own = frozenset(items[a:b])
            number = self.number.setdefault(own, len(self.sets))
            if number == len(self.sets):
                self.sets.append(own)
            out[k] = number
        return out


class Windows:
    """The distinct windows of a block of benchmark items, as numbered words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        same = defaultdict(list)
        for name, text in items:
            if words := tuple(words_of(text)):
                same[words].append(name)
        self.window = window
        self.names = list(same.values())
        self.number: dict[bytes, int] = {}
        numbered = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64) for words in same]
        lengths = np.array([len(ids) for ids in numbered], np.int64)
        self.least = int(min(window, lengths.min())) if len(lengths) else window
        self.sets = ItemSets()
        #: Windows of the full length: sorted keys, their sets, and those of what follows what.
        long = np.flatnonzero(lengths >= window)
        flat = np.concatenate([x for i in long.tolist() for x in (numbered[i], np.zeros(1, np.int64))] + [np.zeros(window, np.int64)])
        begins = np.cumsum(lengths[long] + 1) - lengths[long] - 1
        item = np.repeat(long, np.maximum(lengths[long] - window + 1, 0))
        within = np.arange(len(item)) - np.repeat(np.cumsum(lengths[long] - window + 1) - (lengths[long] - window + 1), lengths[long] - window + 1)
        at = np.repeat(begins, lengths[long] - window + 1) + within
        self.keys, code = np.unique(sortable(sliding_window_view(flat, window)[at]), return_inverse=True)
        self.holders = self.sets.numbers(code, item, len(self.keys))
        follows = within[1:] > 0
        pairs = code[:-1][follows] * max(len(self.keys), 1) + code[1:][follows]
        self.pairs, code = np.unique(pairs, return_inverse=True)
        self.pair_holders = self.sets.numbers(code, item[1:][follows], len(self.pairs))
        #: Items shorter than a window: for each length, sorted keys and whose they are.
        self.short: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(self.least, window):
            own = np.flatnonzero(lengths == n)
            rows = np.stack([numbered[i] for i in own.tolist()]) if len(own) else np.empty((0, n), np.int64)
            padding = ((0, 0), (0, window - n))
            low, high = sortable(np.pad(rows, padding)), sortable(np.pad(rows, padding, constant_values=2**31 - 1))
            self.short.append((n, low, high, own))

    def found(self, documents: list[list[bytes]]) -> list[tuple[list[tuple[int, int, str]], list[str]]]:
        """(start, end, item) of the matches in each document of a shard, and all items matched.

        Of equal items a match names the first.
        """
        none: list[tuple[list[tuple[int, int, str]], list[str]]] = [([], []) for _ in documents]
        if not self.names:
            return none
        get = self.number.get
        sizes = np.array([len(d) + 1 for d in documents])
        begins = np.cumsum(sizes) - sizes
        word = np.zeros(int(sizes.sum()) + self.window, np.int64)
        for begin, document in zip(begins.tolist(), documents):
            word[begin : begin + len(document)] = [get(w, 0) for w in document]
        # Words up to the end of the stretch; shorter suffixes cannot hold a window.
        stop = np.flatnonzero(word == 0)
        known = np.flatnonzero(word)
        left = stop[np.searchsorted(stop, known)] - known
        suffixes = known[left >= self.least]
        if not suffixes.size:
            return none
        left = left[left >= self.least]
        ahead = np.arange(self.window)
        leading = sortable(np.where(ahead < left[:, None], word[suffixes[:, None] + ahead], 0))
        order = np.argsort(leading, kind="stable")
        array, leading = suffixes[order], leading[order]
        rows = self._long(array, leading)
        for n, low, high, own in self.short:
            place, key = _ranges(array, np.searchsorted(leading, low, "left"), np.searchsorted(leading, high, "right"))
            rows += [(p, p + n, i) for p, i in zip(place.tolist(), own[key].tolist())]
        of = (np.searchsorted(begins, [start for start, _, _ in rows], "right") - 1).tolist()
        items: list[set[int]] = [set() for _ in documents]
        for d, (start, end, item) in zip(of, rows):
            b = int(begins[d])
            none[d][0].append((start - b, end - b, self.names[item][0]))
            items[d].add(item)
        return [(matches, [name for i in sorted(own) for name in self.names[i]]) for (matches, _), own in zip(none, items)]

    def _long(self, array: np.ndarray, leading: np.ndarray) -> list[tuple[int, int, int]]:
        """Matches of whole windows: runs of places whose windows follow each other in an item."""
        place, key = _ranges(array, np.searchsorted(leading, self.keys, "left"), np.searchsorted(leading, self.keys, "right"))
        if not place.size:
            return []
        order = np.argsort(place)
        place, key = place[order], key[order]
        # The set of each step to the next place: -1 where that place holds no window, or one that follows nowhere.
        pair = key[:-1] * max(len(self.keys), 1) + key[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        there = (np.diff(place) == 1) & (self.pairs[at] == pair if len(self.pairs) else False)
        step = np.append(np.where(there, self.pair_holders[at] if len(self.pairs) else -1, -1), -1)
        own = self.holders[key]
        # Where all items of a place go on to the next and no others begin there, nothing has to be done.
        same = (step[:-1] == own[:-1]) & (step[:-1] == own[1:])
        out: list[tuple[int, int, int]] = []
        open_: list[tuple[int, frozenset[int]]] = []  # where matches began, and of which items
        sets, none = self.sets.sets, frozenset()
        begin = 0
        for k in np.flatnonzero(~np.append(same, False)).tolist():
            # From ``begin`` to place k nothing changes; its items are those open, or all if it begins here.
            open_ = open_ or [(int(place[begin]), sets[own[begin]])]
            begin = k + 1
            going = sets[step[k]] if step[k] >= 0 else none
            still = []
            for start, items in open_:
                out += [(start, int(place[k]) + self.window, item) for item in items - going]
                if items & going:
                    still.append((start, items & going))
            open_ = still
            if step[k] >= 0 and (fresh := sets[own[k + 1]] - going):
                open_.append((int(place[k + 1]), fresh))
        return out


def _ranges(array: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all ranges of a suffix array, and the number of the range of each."""
    n = last - first
    key = np.repeat(np.arange(len(n)), n)
    return array[np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)], key


def sortable(keys: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort like the rows."""
    rows, width = keys.shape
    if not rows:
        return np.empty(0, f"S{4 * width}")
    return np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * width}").ravel()


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[bytes]:
    """The window tables of the blocks, made in tasks; the driver holds one at a time."""
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        windows = Windows(list(zip(rows["item"], rows["text"])), window)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "windows": [pickle.dumps(windows)]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)))  # equal texts in one block
    tables = stored(dealt.groupBy("block").applyInPandas(made, "block bigint, windows binary"), "benchmark-windows")
    for block in range(n):
        for row in tables.where(F.col("block") == block).select("windows").toLocalIterator():
            yield bytes(row["windows"])


def _searched(text: Column, block: Broadcast) -> Column:
    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows: Windows = pickle.loads(block.value)
        for batch in batches:
            if not len(batch):
                yield pd.DataFrame({"n_words": pd.Series([], dtype="int64"), "matches": [], "items": []})
            for texts in slices(batch, SHARD_CHARS):
                documents = [words_of(t) for t in texts]
                found = windows.found(documents)
                yield pd.DataFrame(
                    {
                        "n_words": [len(d) for d in documents],
                        "matches": [[{"start": a, "end": b, "item": i} for a, b, i in m] for m, _ in found],
                        "items": [items for _, items in found],
                    }
                )

    return run(text)


def with_matches(
    documents: DataFrame,
    benchmark: DataFrame,
    into: str,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The documents with a struct column ``into``: n_words, the matches, and all items matched.

    A match is (start, end, item): word places, end exclusive, and an item it comes from.
    More than one block is searched one after the other, each in a pass of its own that writes
    what it finds; the documents are written once, with a number for each row.
    """
    context = documents.sparkSession.sparkContext
    numbered = Numbered(documents)
    whole = F.col(numbered.name(text))
    blocks = _blocks(benchmark, item_id, item_text, window)
    first = next(blocks, pickle.dumps(Windows([], window)))
    second = next(blocks, None)
    if second is None:
        found = numbered.rows.withColumn("found", _searched(whole, context.broadcast(first)))
        return numbered.back(found, F.col("found").alias(into), without=(into,))
    rows = stored(numbered.rows.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
    parts = []
    for block in _chained(first, second, blocks):
        sent = context.broadcast(block)
        found = rows.select("row", _searched(whole, sent).alias("found"))
        parts.append(stored(found, "benchmark-matches"))
        sent.destroy()
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    summed = union.groupBy("row").agg(
        F.max("found.n_words").alias("n_words"),
        F.flatten(F.collect_list("found.matches")).alias("matches"),
        F.flatten(F.collect_list("found.items")).alias("items"),
    )
    joined = rows.join(summed.select("row", F.struct("n_words", "matches", "items").alias("found")), "row")
    return numbered.back(joined, F.col("found").alias(into), without=(into,))


def _chained(first: bytes, second: bytes, more: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield second
    yield from more


def n_hit(matches: Column) -> Column:
    """Words inside at least one match."""
    return covered(matches)


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a match, columns as they were."""
    numbered = Numbered(documents)
    plain = numbered.rows.withColumn("text", F.col(numbered.name("text")))
    found = with_matches(plain, benchmark, "found", window=window)
    return numbered.back(found.where(F.size("found.matches") == 0))
