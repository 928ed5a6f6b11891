"""Substring dedup by level-wise doubling.

A passage is repeated if its words start at another place too, in the same text or another.
The lengths double from a short one up to the window (9, 18, 35 words for 35). At each
length below the window, a window is known by the least hash among its shorter windows: two
equal windows have the same one. Only windows whose representative occurs at least twice go
on to the next length; at the full length every window left is compared by its own hash. A
wrong removal would need 64-bit hashes of two different passages to agree at every length.

Copies of a whole text fold to one text with a count first; what travels between the levels
are hashes with the number of a text, never pairs of texts or places.

Rows: a null text has no words; a text of fewer words than the window loses nothing. Repeated
rows count as places of their own, so all their windows are repeated. Null ids and other
columns pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, stored

WINDOW = 35
SHORTEST = 9
LONGS = "array<bigint>"


def lengths(window: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths in ascending order, each at most twice the one before."""
    found = [window]
    while found[0] > shortest:
        found.insert(0, (found[0] + 1) // 2)
    return found


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One hash of two hashes in this order."""
    z = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(32))


def window_hashes(words: list[bytes], length: int) -> np.ndarray:
    """Hash of the window of so many words at each place where one starts."""
    n = len(words)
    if n < length:
        return np.empty(0, np.uint64)
    if length == 1:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for w in words), np.uint64, n)
    half = (length + 1) // 2
    halves = window_hashes(words, half)
    count = n - length + 1
    # 0 stands for no window.
    return np.maximum(mixed(halves[:count], halves[length - half : length - half + count]), np.uint64(1))


def representatives(words: list[bytes], length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a full window, the least hash of its windows of ``length`` words.

    The second array has the place of that hash, the first one where it is there twice.
    """
    count = max(0, len(words) - window + 1)
    least = window_hashes(words, length) if count else np.empty(0, np.uint64)
    place = np.arange(len(least))
    width, have = window - length + 1, 1
    while have < width and count:
        step = min(have, width - have)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        have += step
    return least, place


def values_of(least: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Distinct representatives of the windows left (0 elsewhere), twice if at several places."""
    left = np.flatnonzero(least)
    place = place[left]
    # Places never go back from window to window.
    new = np.flatnonzero(np.diff(place, prepend=-1))
    distinct, counts = np.unique(least[left[new]], return_counts=True)
    return np.concatenate((distinct, distinct[counts > 1])).view(np.int64)


def words_in(text: str) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode("utf-8", "replace").split()


def left_over(least: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """The representatives with those that are not known to repeat set to 0."""
    if known is None:
        return least
    return np.where(np.isin(least, known.astype(np.int64).view(np.uint64)), least, np.uint64(0))


def _first_pass(text: Column, window: int, length: int) -> Column:
    @F.pandas_udf(f"n_words: bigint, sha256: string, vals: {LONGS}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for texts in slices(batch, 1 << 30):
                for words in map(words_in, texts):
                    values = values_of(*representatives(words, length, window))
                    rows.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest(), values))
            yield pd.DataFrame(rows, columns=["n_words", "sha256", "vals"])

    return run(text)


def _next_values(text: Column, known: Column, window: int, before: int, length: int) -> Column:
    """Values at the next length, of the windows whose values before are known to repeat."""

    @F.pandas_udf(LONGS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sets in batches:
            out = []
            for text, some in zip(texts, sets):
                words = words_in(text)
                alive = left_over(representatives(words, before, window)[0], some)
                least, place = representatives(words, length, window)
                out.append(values_of(np.where(alive != 0, least, np.uint64(0)), place))
            yield pd.Series(out, dtype=object)

    return run(text, known)


def _spans(text: Column, known: Column, window: int) -> Column:
    @F.pandas_udf("n_removed: bigint, sha256: string, removed: array<struct<start: int, end: int>>, kept: string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, sets in batches:
            rows = []
            for text, some in zip(texts, sets):
                words = words_in(text)
                starts = np.flatnonzero(left_over(window_hashes(words, window), some))
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                inside = np.cumsum(edge)[: len(words)] > 0
                kept = b" ".join([w for w, gone in zip(words, inside.tolist()) if not gone])
                turns = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
                spans = [{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]
                rows.append((int(inside.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode()))
            yield pd.DataFrame(rows, columns=["n_removed", "sha256", "removed", "kept"])

    return run(text, known)


def _repeated(values: DataFrame, weight: Column) -> DataFrame:
    """The hashes that occur at two places or more."""
    return values.groupBy("h").agg(F.sum(weight).alias("n")).where("n > 1").select("h")


class Repeats:
    """Repeated passages of a table of texts.

    ``rows`` has a row for each document: ``keep`` columns, key and digest of its text,
    n_words and sha256 of its words. ``passages`` has a row for each different text with
    repeated windows: key, digest, ``found`` (n_removed, removed word spans, kept text, sha256).
    """

    def __init__(self, documents: DataFrame, *keep: str, text: str = "text", window: int = WINDOW, shortest: int = SHORTEST):
        first, *more = lengths(window, shortest)
        whole = F.coalesce(F.col(text), F.lit(""))
        named = documents.select(*keep, F.xxhash64(whole).alias("key"), F.unhex(F.md5(whole)).alias("digest"), whole.alias("whole"))
        self.rows = stored(
            named.withColumn("p", _first_pass(F.col("whole"), window, first)).select(*keep, "key", "digest", "p.*"),
            "first-pass",
        )
        values = self.rows.select("key", F.explode("vals").alias("h"))
        known = (
            values.join(_repeated(values, F.lit(1)), "h", "left_semi").groupBy("key").agg(F.collect_set("h").alias("known"))
        )
        copies = self.rows.groupBy("key", "digest").agg(F.least(F.count("*"), F.lit(2)).alias("copies"))
        left = copies.join(known, "key")
        texts = named.groupBy("key", "digest").agg(F.first("whole").alias("whole"))
        candidates = stored(
            texts.join(left, ["key", "digest"]).withColumn("id", F.monotonically_increasing_id()), "candidates"
        )
        everything = F.lit(None).cast(LONGS)
        bare = candidates.select("id", "key", "digest", "copies", "whole")
        before, now = first, candidates.withColumn("known", F.when(F.col("copies") == 1, F.col("known")))
        for length in more:
            values = stored(
                now.select(
                    "id", "copies", F.explode(_next_values(F.col("whole"), F.col("known"), window, before, length)).alias("h")
                ),
                "values",
            )
            known = (
                values.where("copies = 1")
                .join(_repeated(values, F.col("copies")), "h", "left_semi")
                .groupBy("id")
                .agg(F.collect_set("h").alias("known"))
            )
            # All windows of a text that has copies are repeated; the others need a value left.
            now = bare.join(known, "id", "left").where("copies = 2 or known is not null")
            before = length
        if not more:
            now = candidates.withColumn("known", F.when(F.col("copies") == 1, F.col("known")).otherwise(everything))
        self.passages = now.select("key", "digest", _spans(F.col("whole"), F.col("known"), window).alias("found"))


def without_repeats(documents: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with the repeated passages taken out of their texts.

    A text that loses nothing stays as it is; one that loses words is its kept words, joined
    by one space. All other columns stay.
    """
    passages = Repeats(documents, text=text, window=window).passages
    whole = F.coalesce(F.col(text), F.lit(""))
    met = documents.withColumn("__key", F.xxhash64(whole)).withColumn("__digest", F.unhex(F.md5(whole)))
    found = passages.select(F.col("key").alias("__key"), F.col("digest").alias("__digest"), F.col("found.kept").alias("__kept"))
    return met.join(found, ["__key", "__digest"], "left").select(
        *[F.coalesce("__kept", text).alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns]
    )
