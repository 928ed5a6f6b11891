"""Alignment of two tokenizers by galloping intersection of their token ends.

Both tokenizers cover the same bytes, so a text is two lists of ends. Each end of the shorter
list is sought in the longer: steps that double bracket its place, a binary search inside the
bracket finds it. An end found in both lists closes a group. The places found are ranks: the
tokens of the longer list that a token of the shorter overlaps begin at the rank of its start
and end at the rank of its end, so differences of ranks give all links without comparing tokens.

How many documents hold an id pair linked is counted over the whole corpus. Documents are
worked on in blocks of bounded size; a block lists its distinct pairs once, with the number of
its documents that hold each. These lists, not the links, are exchanged: they are summed by
pair, and each block gets back the sums of its own pairs.

Rows: a null or empty text has no tokens, like one whose tokens do not join to the text's bytes
after a space; its numbers are zero and its groups empty. Each row gives one row, repeated ones
too, and null ids stay null. Other columns are left out, whatever their names. An empty table
gives an empty one. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.bpe import byte_characters
from shelfmark.llm.common import BYTE_BPE, PIECE_BPE, slices, stored, vocabulary_path

#: Characters of text in a block.
BLOCK_CHARS = 2_000_000
#: The split of byte-level BPE (a fixed value of the file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokens:
    """Ids of a run of texts laid end to end, with how many each text has."""

    def __init__(self, ids: list[np.ndarray]):
        self.counts = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int64)


class ByteBpe:
    """The byte-level tokenizer of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in entry): i for entry, i in vocab.items() if entry not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if made != sorted(made):
            raise ValueError("the ids of merged entries do not follow the order of the merges")
        self.entries = [b""] * (1 + max(*vocab.values(), *special.values()))
        for entry, i in ranks.items():
            self.entries[i] = entry
        for entry, i in special.items():
            self.entries[i] = entry.encode()
        self.merged = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; strings of special tokens are plain text."""
        return [self.merged.encode_to_numpy(text, disallowed_special=()).astype(np.int32) for text in texts]


class Pieces:
    """The sentencepiece tokenizer."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        self.entries = [
            bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in zip(ids, self.library.id_to_piece(list(ids)))
        ]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.library.encode(texts, num_threads=1)]


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Rank of each entry of ``short``: the entries of ``long`` below it, which is not all of them.

    From the guessed place steps of 1, 2, 4, ... go towards the entry until they have passed
    it; a binary search between the last two places finds it. All entries move together.
    """
    below = long[guess] < short
    under = np.where(below, guess, -1)  # long[under] < entry <= long[above]
    above = np.where(below, len(long) - 1, guess)
    step, moving = 1, np.flatnonzero(below)
    while moving.size:
        probe = np.minimum(guess[moving] + step, len(long) - 1)
        passed = long[probe] >= short[moving]
        above[moving[passed]] = probe[passed]
        moving, probe = moving[~passed], probe[~passed]
        under[moving] = probe
        step *= 2
    step, moving = 1, np.flatnonzero(~below)
    while moving.size:
        probe = guess[moving] - step
        passed = (probe < 0) | (long[np.maximum(probe, 0)] < short[moving])
        under[moving[passed]] = np.maximum(probe[passed], -1)
        moving, probe = moving[~passed], probe[~passed]
        above[moving] = probe
        step *= 2
    moving = np.flatnonzero(above - under > 1)
    while moving.size:
        middle = (above[moving] + under[moving]) >> 1
        low = long[middle] < short[moving]
        under[moving[low]] = middle[low]
        above[moving[~low]] = middle[~low]
        moving = moving[above[moving] - under[moving] > 1]
    return above


class Aligned:
    """Groups and links of a run of texts; both token lists join to the same bytes."""

    def __init__(self, a: Tokens, b: Tokens, a_sizes: np.ndarray, b_sizes: np.ndarray):
        a_shorter = len(a.ids) <= len(b.ids)
        short, long = (a, b) if a_shorter else (b, a)
        short_ends = np.cumsum((a_sizes if a_shorter else b_sizes)[short.ids])
        long_ends = np.cumsum((b_sizes if a_shorter else a_sizes)[long.ids])
        self.text_of = np.repeat(np.arange(len(short.counts)), short.counts)
        # Even spread inside the text: where the search of an entry begins.
        first_short = np.cumsum(short.counts) - short.counts
        first_long = np.cumsum(long.counts) - long.counts
        within = np.arange(len(short.ids)) - first_short[self.text_of]
        guess = first_long[self.text_of] + within * long.counts[self.text_of] // np.maximum(short.counts, 1)[self.text_of]
        rank = gallop(short_ends, long_ends, guess)
        shared = long_ends[rank] == short_ends if len(rank) else np.empty(0, bool)
        # Overlap of a token: from the rank of its start to the rank of its end.
        begin = np.concatenate(([0], (rank + shared)[:-1])) if len(rank) else rank
        reach = rank - begin + 1
        at_short = np.repeat(np.arange(len(rank)), reach)
        at_long = np.arange(len(at_short)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(begin, reach)
        self.a, self.b = a, b
        at_a, at_b = (at_short, at_long) if a_shorter else (at_long, at_short)
        self.link_text = self.text_of[at_short]
        self.link_a, self.link_b = a.ids[at_a], b.ids[at_b]
        ends_short = np.flatnonzero(shared)
        self.group_text = self.text_of[ends_short]
        #: Tokens up to the end of each group, on both sides.
        self.group_a, self.group_b = (ends_short + 1, rank[shared] + 1) if a_shorter else (rank[shared] + 1, ends_short + 1)

    def group_texts(self, labels: GroupLabels) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        n_a, n_b = len(self.a.ids), len(self.b.ids)
        order = np.empty(n_a + n_b, np.int64)
        last_a, last_b = np.zeros(n_a, bool), np.zeros(n_b, bool)
        last_a[self.group_a - 1] = True
        last_b[self.group_b - 1] = True
        # A token stands after the tokens before it and the other side's of earlier groups.
        group_of_a, group_of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order[np.arange(n_a) + np.concatenate(([0], self.group_b))[group_of_a]] = labels.a(self.a.ids, last_a)
        order[np.arange(n_b) + np.concatenate((self.group_a, [0]))[group_of_b]] = labels.b(self.b.ids, last_b)
        shown = list(map(labels.shown.__getitem__, order.tolist()))
        ends = np.cumsum(self.a.counts + self.b.counts).tolist()
        return ["".join(shown[i:j])[:-1] for i, j in zip([0, *ends[:-1]], ends)]


class GroupLabels:
    """Ids as text, each with the sign that follows it."""

    def __init__(self, n_a: int, n_b: int):
        self.n = max(n_a, n_b)
        self.shown = [f"{i}{sign}" for sign in ",|;" for i in range(self.n)]

    def a(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return ids + last * self.n

    def b(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return ids + last * 2 * self.n


class Aligner:
    """Both tokenizers, as a worker holds them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBpe(a_path), Pieces(b_path)
        self.a_sizes = np.array([len(e) for e in self.a.entries], np.int64)
        self.b_sizes = np.array([len(e) for e in self.b.entries], np.int64)
        if not (self.a_sizes.all() and self.b_sizes.all()):
            raise ValueError("a vocabulary has an entry without bytes")

    @cached_property
    def labels(self) -> GroupLabels:
        return GroupLabels(len(self.a_sizes), len(self.b_sizes))

    def encode(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """Tokens of each text on both sides; none where they do not join to its bytes."""
        spaced = [f" {text}" if text else "" for text in texts]
        none = np.empty(0, np.int32)
        both = []
        for text, a, b in zip(spaced, self.a.encode(spaced), self.b.encode(texts)):
            # Bytes never change on the A side, whose entries are merged from them.
            same = b"".join(map(self.b.entries.__getitem__, b.tolist())) == text.encode()
            both.append((a, b) if same else (none, none))
        return Tokens([a for a, _ in both]), Tokens([b for _, b in both])

    def align(self, texts: list[str]) -> Aligned:
        return Aligned(*self.encode(texts), self.a_sizes, self.b_sizes)


@cache
def loaded(a_path: str, b_path: str) -> Aligner:
    """The tokenizers, read once per worker."""
    return Aligner(a_path, b_path)


def _counted(texts: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(texts, minlength=n).astype(np.int64)


class Alignment:
    """Two tokenizers aligned over a table of texts.

    ``documents`` has a row for each row of the table: the id, n_a and n_b tokens, n_groups,
    n_links, n_best (links whose pair is the most widespread of its A id, ties included),
    count_sum (the documents that hold a link's pair, summed over the links) and groups_sha256.
    ``pairs`` is the mapping itself: a_id, b_id, the documents that hold the pair linked, and
    whether it is the A id's best.
    """

    def __init__(self, documents: DataFrame, id_column: str, a_path: str | None = None, b_path: str | None = None):
        self.a_path = a_path or vocabulary_path(BYTE_BPE)
        self.b_path = b_path or vocabulary_path(PIECE_BPE)
        self.id_kind = documents.schema[id_column].dataType.simpleString()
        # As text, ids pass through pandas unharmed, null or not.
        source = documents.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col("text").alias("text"))
        # Written, so that a block's name is drawn once.
        self.blocks = stored(self._aligned_blocks(source), "alignment-blocks")
        self.held = stored(
            self.blocks.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "pair")).select(
                "block", "at", F.col("pair.pairs").alias("pair"), F.col("pair.holders").alias("holders")
            ),
            "alignment-held",
        )
        self.pairs = stored(self._pair_counts(), "alignment-pairs")

    def _aligned_blocks(self, source: DataFrame) -> DataFrame:
        a_path, b_path = self.a_path, self.b_path

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            aligner = loaded(a_path, b_path)
            for batch in batches:
                done = 0
                for texts in slices(batch["text"], BLOCK_CHARS):
                    ids = batch["id"].iloc[done : done + len(texts)]
                    done += len(texts)
                    yield _block_rows(ids, texts, aligner)

        return source.mapInPandas(
            run,
            "id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
            "links binary, times binary, block string, pairs array<bigint>, holders array<int>",
        )

    def _pair_counts(self) -> DataFrame:
        """Documents of each pair over the whole corpus, and whether it is its A id's best.

        An A id has at most as many pairs as the other vocabulary has entries.
        """
        counts = self.held.groupBy("pair").agg(F.sum("holders").alias("n_documents"))
        a_id = F.shiftright("pair", 32)
        most = F.max("n_documents").over(Window.partitionBy(a_id))
        return counts.select(
            "pair",
            a_id.cast("int").alias("a_id"),
            F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"),
            "n_documents",
            (F.col("n_documents") == most).alias("best"),
        )

    @property
    def documents(self) -> DataFrame:
        """Numbers of every row."""
        known = self.held.join(self.pairs.select("pair", "n_documents", "best"), "pair").select("block", "at", "n_documents", "best")
        rows = self.blocks.select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times")

        def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            n, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            n[known["at"]] = known["n_documents"]
            best[known["at"]] = known["best"]
            links = [np.frombuffer(x, np.int32) for x in rows["links"]]
            times = [np.frombuffer(x, np.int32).astype(np.int64) for x in rows["times"]]
            return rows[["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].assign(
                n_best=[int(best[i] @ t) for i, t in zip(links, times)],
                count_sum=[int(n[i] @ t) for i, t in zip(links, times)],
            )

        both = rows.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
            run,
            "id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
            "n_best bigint, count_sum bigint",
        )
        return both.withColumn("id", F.col("id").cast(self.id_kind))


def _block_rows(ids: pd.Series, texts: list[str], aligner: Aligner) -> pd.DataFrame:
    """Rows of one block; its first row also lists the distinct pairs of the whole block."""
    found = aligner.align(texts)
    n = len(texts)
    pairs, code = np.unique(found.link_a << 32 | found.link_b, return_inverse=True)
    seen, times = np.unique(found.link_text * max(len(pairs), 1) + code, return_counts=True)
    text_of, links = np.divmod(seen, max(len(pairs), 1))
    cuts = np.searchsorted(text_of, np.arange(n + 1))
    links, times = links.astype(np.int32), times.astype(np.int32)
    holders = np.bincount(links, minlength=len(pairs)).astype(np.int32)
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.group_texts(aligner.labels)]
    return pd.DataFrame(
        {
            "id": ids.array,
            "n_a": found.a.counts,
            "n_b": found.b.counts,
            "n_groups": _counted(found.group_text, n),
            "n_links": _counted(found.link_text, n),
            "groups_sha256": digests,
            "links": [links[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])],
            "times": [times[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])],
            "block": uuid.uuid4().hex,
            "pairs": [pairs, *[None] * (n - 1)],
            "holders": [holders, *[None] * (n - 1)],
        }
    )
