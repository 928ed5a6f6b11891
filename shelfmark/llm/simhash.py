"""Near-duplicate groups of SimHash fingerprints, found through Golay codes.

A fingerprint (64 bits) is cut into segments of 23, 23 and 18 bits. The perfect Golay code
of 23 bits gives every segment the index of its nearest codeword; a segment and its 23
neighbours at one bit decode to at most six indices, and two segments that differ in at most
two bits share one of them. If two fingerprints differ in at most two bits, at least one of
the three segments is the same in both (pigeonhole) and the next one differs in at most two
bits. So keys of (equal segment, index of the next) bring every such pair together; pairs
that meet are verified by counting bits.

Copies first fold to distinct fingerprints. A key with more than ``KEY_ROWS`` fingerprints
is not paired: each of its fingerprints is linked with the 64 words one bit away, and two
differ in at most two bits exactly if they share such a word (or are one). So no key costs
more than in proportion to its rows, and no link is lost. Links are joined into components
by repeated minimum steps over written tables.

Rows: null or wordless texts have fingerprint zero and are linked like any other. Rows with
a null id count as documents; a group of only null ids has a null component. Repeated rows
are returned as often as given. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import Numbered, stored

SHINGLE_WORDS = 3
#: Bits in which linked fingerprints may differ; the keys find two and fewer.
BITS = 2
SEED = 42
KEY_ROWS = 16
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint_of(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the hashes of all shingles, as an unsigned number."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle_words))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # bounded memory for a text of any length
        bits = np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


@cache
def fingerprint(shingle_words: int = SHINGLE_WORDS) -> Callable[[Column], Column]:
    """SimHash of each whole text; the 64 bits as a signed number."""

    @F.pandas_udf(T.LongType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = np.array([fingerprint_of(t, shingle_words) if isinstance(t, str) else 0 for t in batch], np.uint64)
            yield pd.Series(found.view(np.int64))

    return run


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


@cache
def nearest() -> np.ndarray:
    """Codeword index (its 12 message bits) of the codeword nearest to each 23-bit word."""

    def remainder(w: np.ndarray) -> np.ndarray:
        w = w.copy()
        for bit in range(22, 10, -1):
            w ^= np.where(w >> np.uint32(bit) & 1, np.uint32(GOLAY << (bit - 11)), np.uint32(0))
        return w

    errors = np.array([sum(1 << b for b in c) for n in range(4) for c in combinations(range(23), n)], np.uint32)
    pattern = np.zeros(1 << 11, np.uint32)
    pattern[remainder(errors)] = errors
    index = np.empty(1 << 23, np.uint16)
    for first in range(0, 1 << 23, 1 << 18):  # in parts, for the sake of memory
        words = np.arange(first, first + (1 << 18), dtype=np.uint32)
        index[first : first + (1 << 18)] = (words ^ pattern[remainder(words)]) >> np.uint32(11)
    return index


def keys_of(fps: np.ndarray) -> list[np.ndarray]:
    """All keys of each fingerprint (unsigned 64-bit numbers)."""
    index = nearest()
    parts = [(fps >> np.uint64(at)) & np.uint64((1 << size) - 1) for at, size in SEGMENTS]
    out: list[np.ndarray] = []
    columns = []
    for i, part in enumerate(parts):
        following = parts[(i + 1) % 3].astype(np.int64)
        ball = np.stack([index[following], *(index[following ^ (1 << b)] for b in range(23))], axis=1)
        columns.append((np.uint64(i) << np.uint64(35) | part << np.uint64(12))[:, None] | ball.astype(np.uint64))
    for row in np.concatenate(columns, axis=1) if len(fps) else []:
        out.append(np.unique(row).astype(np.int64))
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def golay_keys(fps: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Keys under which a fingerprint meets all those that differ in at most two bits."""
    for batch in fps:
        yield pd.Series(keys_of(batch.to_numpy(np.int64).view(np.uint64)), dtype=object)


def links(fps: DataFrame, key_rows: int = KEY_ROWS, bits: int = BITS) -> DataFrame:
    """Links (a, b) at ``bits`` or fewer bits that reach all that such links between ``fp`` reach."""
    if not 0 <= bits <= 2:
        raise ValueError("the keys find fingerprints that differ in two or fewer bits")
    if bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    keys = stored(fps.select("fp", F.explode(golay_keys("fp")).alias("key")), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(keys.join(sizes, "key"), "golay-met")
    few = met.where(F.col("n") <= key_rows).select("key", "fp")
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits))
        .select("a", "b")
    )
    masks = F.array(*[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)])
    near = met.where(F.col("n") > key_rows).select("fp").distinct()
    points = near.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    points = points.unionByName(near.select("fp", F.col("fp").alias("point")))
    if bits == 1:  # two differ in one bit exactly if one is a word one bit away from the other
        hubs = points.join(near.select(F.col("fp").alias("point")), "point").where(F.col("fp") < F.col("point"))
        return pairs.unionByName(hubs.select(F.col("fp").alias("a"), F.col("point").alias("b"))).distinct()
    shared = points.groupBy("point").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1")
    hubs = points.join(shared.select("point", "least"), "point").where(F.col("fp") != F.col("least"))
    return pairs.unionByName(hubs.select(F.col("least").alias("a"), F.col("fp").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the links (a, b), for nodes with links.

    Alternating steps: larger neighbours go to the smallest neighbour, then smaller ones do.
    Links never grow in number and the last tables are stars around the roots.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.where(F.col("b") > F.col("a"))
            .join(least, "a")
            .select(F.col("m").alias("a"), "b")
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        # Now each node b points to smaller ones; they and b go to the smallest of them.
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(down, "b")
            .select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        following = stored(small, "links")
        old, new = (
            x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
            for x in (edges, following)
        )
        edges = following
        if old == new:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )


def near_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", *more: Column, shingle_words: int = SHINGLE_WORDS, bits: int = BITS
) -> DataFrame:
    """(doc_id, fp, root, component_id, *more) for each row of the documents, from one written table.

    Links join fingerprints that differ in at most ``bits`` bits. ``root`` names the component
    by one of its fingerprints, ``component_id`` by the smallest id in it.
    """
    made = fingerprint(shingle_words)(F.col(f"`{text}`")).alias("fp")
    prints = stored(documents.select(F.col(f"`{doc_id}`").alias("doc_id"), made, *more), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    rooted = components(links(distinct, bits=bits))
    named = distinct.join(rooted, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(labels, "fp")


def one_of_each(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, bits: int = BITS) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Rows that are equal in all columns are told apart by nothing; one of them stays. Ties of
    one id with different contents are settled by a hash of the whole row; a null id loses
    against any other.
    """
    numbered = Numbered(documents)
    doc_id = F.col(numbered.name("doc_id"))
    whole = F.xxhash64(F.lit(0), *[F.col(n) for n, kind in numbered.rows.dtypes if "map<" not in kind])
    of = numbered.name("doc_id"), numbered.name("text")
    groups = stored(near_duplicates(numbered.rows, *of, whole.alias("whole"), shingle_words=shingle_words, bits=bits), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "whole")
    first = groups.groupBy("root").agg(F.min(order).alias("first"))
    keep = first.select(F.col("first.doc_id").alias("keep_id"), F.col("first.whole").alias("keep_whole"))
    met = numbered.rows.withColumn("whole", whole).join(
        keep, (F.col("whole") == F.col("keep_whole")) & doc_id.eqNullSafe(F.col("keep_id")), "left_semi"
    )
    turn = F.row_number().over(Window.partitionBy("whole", doc_id).orderBy(doc_id))
    return numbered.back(met.withColumn("turn", turn).where("turn = 1"))
