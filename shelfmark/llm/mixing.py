"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source, in an order drawn from their contents, are one stream of words, cut
into blocks of equal size. A source's target says how many blocks it gives: whole passes over
the stream, then the first blocks of one more pass, the last of them cut to the word. These
quotas are split among the output shards from the root down: each half of a node's shards gets
a multivariate-hypergeometric share of the node's quotas, as if all blocks had been shuffled
and dealt, so every shard has its exact number of blocks and every source its exact quota.
A shard then draws its interval of each source's blocks, in the permuted order of the pass;
intervals do not meet, so neither do the draws. The order inside a shard is a digest of the
draw. Everything is built from DataFrame functions.

A node holds its quotas as an array of at most about the square root of the number of sources:
with more than ``FAN_OUT`` sources the tree splits groups of them, and each group's share at
each node among its members.

Rows: a null text has no words, an empty one neither; nothing of it is taken. Null sources are
one source, the last. Rows equal in id, source and text are rows of their own and may swap what
is taken of them. Other columns are left out, whatever their names. An empty table gives empty
ones. A text of any length is cut by blocks.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import stored

#: Weights of the sources in order, repeating (fixed values).
WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST_PASSES = 3
#: Words of a block and blocks of a shard.
BLOCK_WORDS = 1024
SHARD_BLOCKS = 1024
#: Sources above which the tree splits groups of sources first.
FAN_OUT = 1024
#: Standard deviations on each side of the mode that a draw can reach: beyond lies less than
#: the rounding of a double.
REACH = 12
ROUNDS = 24
WORDS = r"[^\x20\x09-\x0D]+"
#: Levels of the tree that one task walks alone before its nodes are dealt out again.
LEVELS_AT_ONCE = 8


def uniform(*key: Column) -> Column:
    """A number strictly between 0 and 1 drawn from the key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(total: Column, marked: Column, draws: Column, at: Column) -> Column:
    """How many of ``draws`` out of ``total`` are among the ``marked``, by inversion at ``at``.

    Probabilities are taken relative to the mode's, whose neighbours follow by ratios.
    """
    n, k, d = (c.cast("double") for c in (total, marked, draws))
    mode = F.floor((d + 1) * (k + 1) / (n + 2))
    spread = F.sqrt(F.greatest(d * (k / n) * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    reach = F.ceil(spread * REACH) + REACH
    lowest = F.greatest(F.lit(0), draws + marked - total, mode - reach).cast("bigint")
    highest = F.least(draws, marked, mode + reach).cast("bigint")

    def up(x: Column) -> Column:
        """Probability of x + 1 over that of x."""
        return (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

    places = F.sequence(lowest, highest)
    steps_down = F.when(mode > lowest, F.sequence(lowest, (mode - 1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    first = F.aggregate(steps_down, F.lit(1.0), lambda weight, x: weight / up(x))

    def summed(places: Column) -> Column:
        start = F.struct(first.alias("weight"), F.lit(0.0).alias("sum"))
        return F.aggregate(
            places,
            start,
            lambda s, x: F.struct((s["weight"] * up(x)).alias("weight"), (s["sum"] + s["weight"]).alias("sum")),
            lambda s: s["sum"],
        )

    start = F.struct(first.alias("weight"), (at * summed(places)).alias("left"), F.lit(0).cast("bigint").alias("passed"))
    passed = F.aggregate(
        places,
        start,
        lambda s, x: F.struct(
            (s["weight"] * up(x)).alias("weight"),
            (s["left"] - s["weight"]).alias("left"),
            (s["passed"] + (s["left"] > s["weight"]).cast("bigint")).alias("passed"),
        ),
        lambda s: s["passed"],
    )
    return F.when(lowest >= highest, highest).otherwise(F.least(lowest + passed, highest))


def left_share(quotas: Column, draws: Column, *key: Column) -> Column:
    """What a node's left half draws of each quota (structs with ``name`` and ``k``), in order."""
    total = F.aggregate(quotas, F.lit(0).cast("bigint"), lambda s, q: s + q["k"])
    start = F.struct(
        total.alias("total"), draws.cast("bigint").alias("draws"), F.array().cast("array<bigint>").alias("taken")
    )

    def draw(s: Column, q: Column) -> Column:
        x = hypergeometric(s["total"], q["k"], s["draws"], uniform(*key, q["name"]))
        x = F.when((s["draws"] == 0) | (q["k"] == 0), F.lit(0).cast("bigint")).when(s["total"] == q["k"], s["draws"]).otherwise(x)
        # Bound to a name by a one-element array, so that the draw is made once.
        return F.transform(
            F.array(x),
            lambda x: F.struct(
                (s["total"] - q["k"]).alias("total"),
                (s["draws"] - x).alias("draws"),
                F.array_append(s["taken"], x).alias("taken"),
            ),
        )[0]

    return F.aggregate(quotas, start, draw, lambda s: s["taken"])


def permuted(place: Column, n: Column, *key: Column) -> Column:
    """A permutation of 0 .. n - 1 (swap-or-not rounds), drawn from the key."""

    def mix(x: Column, turn: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, turn), n) - x, n)
        swap = F.xxhash64(*key, turn, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), place.cast("bigint"), mix)


class Mix:
    """The mix of a table of documents.

    ``documents`` has the place of every row in its source's stream (id, source, size, first:
    the words before it). ``sources`` has a row for each source: rank in code-point order (null
    last), weight, size, target, and the blocks and words that the mix takes. ``draws`` has a
    row for each drawn block: shard, order inside it, source rank, pass, block and words.
    ``pieces`` cuts the draws by document. ``taken`` sums them for every row of ``documents``.
    """

    def __init__(
        self,
        documents: DataFrame,
        id_column: str,
        *,
        seed: int = 0,
        block_words: int = BLOCK_WORDS,
        shard_blocks: int = SHARD_BLOCKS,
        fan_out: int = FAN_OUT,
        buckets: int | None = None,
    ):
        self.seed = F.lit(seed)
        self.block_words = block_words
        self.shard_blocks = shard_blocks
        self.fan_out = fan_out
        id_value, source, text = F.col(f"`{id_column}`"), F.col("source").cast("string"), F.col("text")
        rows = documents.select(
            id_value.alias("id"),
            source.alias("source"),
            F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("bigint").alias("size"),
            F.xxhash64(self.seed, id_value.cast("string"), source, text).alias("drawn"),
            F.xxhash64(F.lit(1), self.seed, id_value.cast("string"), source, text).alias("tie"),
        )
        self.rows = stored(rows, "mix-rows")
        # By default as many buckets as rows in each, on average: neither grows into a hot group.
        self.buckets = buckets or max(1, math.isqrt(self.rows.count()))
        self.sources = stored(self._sources(), "mix-sources")
        self.documents = stored(self._placed(), "mix-documents")

    # Targets.

    def _sources(self) -> DataFrame:
        sizes = stored(self._ranked(self.rows.groupBy("source").agg(F.sum("size").alias("size"))), "mix-sizes")
        weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
        sizes = sizes.withColumn("weight", weight).withColumn("most", MOST_PASSES * F.col("size"))
        level = self._level(sizes)
        target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
        words = F.least(F.round(target).cast("bigint"), F.col("most"))
        n_blocks = F.ceil(F.col("size") / self.block_words).cast("bigint")
        rest = F.col("words") - F.col("passes") * F.col("size")
        return (
            sizes.withColumn("target", target)
            .withColumn("words", words)
            .withColumn("n_blocks", n_blocks)
            .withColumn("passes", F.when(F.col("size") > 0, F.floor(F.col("words") / F.col("size"))).otherwise(0).cast("bigint"))
            .withColumn("rest", rest)
            .withColumn("blocks", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("rest") / self.block_words).cast("bigint"))
            .drop("most")
        )

    @staticmethod
    def _ranked(sources: DataFrame) -> DataFrame:
        """Ranks in code-point order, null last: counted within sorted ranges, then shifted."""
        ranged = stored(sources.orderBy(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "mix-ranges")
        before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # a row for each range
        shifts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
        within = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
        return ranged.withColumn("within", within).join(shifts, "part").select(
            "source", "size", (F.col("before") + F.col("within")).alias("rank")
        )

    @staticmethod
    def _level(sizes: DataFrame) -> float:
        """Words a weight of 1 gets once no target is above its bound.

        Each turn stops the sources above their bound and reshares what is over; only two sums
        reach the driver.
        """
        total = sizes.agg(F.sum("size")).first()[0] or 0
        level, known = 0.0, None
        while True:
            stopped = F.col("most") <= F.col("weight") * F.lit(level)
            fixed, weight, n = sizes.agg(
                F.coalesce(F.sum(F.when(stopped, F.col("most"))), F.lit(0)),
                F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0)),
                F.count(F.when(stopped, 1)),
            ).first()
            if n == known or not weight:
                return level
            level, known = max(level, (total - fixed) / weight), n

    # The streams.

    def _placed(self) -> DataFrame:
        """Words before each row in its source's stream: sums of buckets, then within one."""
        rows = self.rows.withColumn("bucket", F.pmod("drawn", F.lit(self.buckets)))
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
        before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")
        shifts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
        order = Window.partitionBy("source", "bucket").orderBy("drawn", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
        within = rows.withColumn("within", F.sum("size").over(order) - F.col("size"))
        placed = within.join(shifts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        ranks = self.sources.select(F.col("source").alias("of"), "rank")
        return placed.join(ranks, F.col("source").eqNullSafe(F.col("of"))).select(
            "id", "rank", "size", (F.col("before") + F.col("within")).alias("first")
        )

    # The tree.

    @cached_property
    def n_shards(self) -> int:
        return max(1, math.ceil(self.n_blocks / self.shard_blocks))

    @cached_property
    def n_blocks(self) -> int:
        return self.sources.agg(F.sum("blocks")).first()[0] or 0

    @cached_property
    def quotas(self) -> DataFrame:
        """shard, rank, k, first: the k blocks, from the first on, that a shard draws of a source."""
        sources = self.sources.where("blocks > 0").select("rank", F.col("blocks").alias("k"))
        n = sources.count()
        groups = 1 if n <= self.fan_out else math.ceil(math.sqrt(n))
        entry = F.struct(F.col("rank").alias("name"), "k", F.lit(0).cast("bigint").alias("first"))
        members = sources.groupBy((F.col("rank") % groups).alias("g")).agg(F.array_sort(F.collect_list(entry)).alias("quotas"))
        node = [F.lit(0).cast("bigint").alias("low"), F.lit(self.n_shards).cast("bigint").alias("high")]
        nodes = members.select(*node, "g", "quotas")
        tops = None
        if groups > 1:
            whole = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda s, q: s + q["k"])
            entry = F.struct(F.col("g").alias("name"), whole.alias("k"), F.lit(0).cast("bigint").alias("first"))
            tops = nodes.agg(F.array_sort(F.collect_list(entry)).alias("quotas")).select(*node, F.lit(0).cast("bigint").alias("g"), "quotas")
            nodes = stored(nodes, "mix-nodes")
        for level in range(max(0, self.n_shards - 1).bit_length()):
            if tops is None:
                nodes = self._split(nodes, self._left_slots())
            else:
                # What the groups drew at this level is what their members have to share out.
                tops = stored(self._split(tops, self._left_slots(), keep_parent=True), "mix-groups")
                lefts = tops.where("is_left").select("parent_low", "parent_high", F.explode("quotas").alias("q")).select(
                    F.col("parent_low").alias("low"), F.col("parent_high").alias("high"), F.col("q.name").alias("g"), F.col("q.k").alias("draws")
                )
                joined = nodes.join(lefts, ["low", "high", "g"], "left")
                nodes = stored(self._split(joined, F.coalesce("draws", F.lit(0))), "mix-nodes")
                tops = tops.select("low", "high", "g", "quotas")
            if tops is None and level % LEVELS_AT_ONCE == LEVELS_AT_ONCE - 1:
                nodes = stored(nodes.repartition(2**LEVELS_AT_ONCE, "low"), "mix-nodes")
        return nodes.select(F.col("low").alias("shard"), F.explode("quotas").alias("q")).select(
            "shard", F.col("q.name").alias("rank"), F.col("q.k").alias("k"), F.col("q.first").alias("first")
        )

    def _left_slots(self) -> Column:
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        return self._before(middle) - self._before(F.col("low"))

    def _before(self, shard: Column) -> Column:
        """Blocks in the shards before this one; whole numbers all the way."""
        each, more = divmod(self.n_blocks, self.n_shards)
        return shard * each + F.least(shard, F.lit(more))

    def _split(self, nodes: DataFrame, draws: Column, keep_parent: bool = False) -> DataFrame:
        """Both halves of every node; a node of one shard stays as it is."""
        one = F.col("high") - F.col("low") <= 1
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("bigint")
        taken = left_share(F.col("quotas"), draws, self.seed, F.col("low"), F.col("high"), F.col("g"))
        drawn = nodes.withColumn("taken", F.when(~one, taken))

        def half(low: Column, high: Column, left: bool) -> Column:
            share = F.zip_with(
                "quotas",
                "taken",
                lambda q, t: F.struct(
                    q["name"].alias("name"),
                    (t if left else q["k"] - t).alias("k"),
                    (q["first"] if left else q["first"] + t).alias("first"),
                ),
            )
            return F.struct(
                low.alias("low"),
                high.alias("high"),
                F.filter(F.when(one, F.col("quotas")).otherwise(share), lambda q: q["k"] > 0).alias("quotas"),
                F.lit(left).alias("is_left"),
            )

        halves = F.when(one, F.array(half(F.col("low"), F.col("high"), True))).otherwise(
            F.array(half(F.col("low"), middle, True), half(middle, F.col("high"), False))
        )
        split = drawn.select(F.col("low").alias("parent_low"), F.col("high").alias("parent_high"), "g", F.explode(halves).alias("half"))
        kept = ["parent_low", "parent_high", "half.is_left"] if keep_parent else []
        return split.select("half.low", "half.high", "g", "half.quotas", *kept)

    # The draws.

    @cached_property
    def draws(self) -> DataFrame:
        """A row for each drawn block; its words may be fewer at a stream's end or the last draw."""
        drawn = self.quotas.select(
            "shard", "rank", F.explode(F.sequence("first", F.col("first") + F.col("k") - 1)).alias("draw")
        ).join(self.sources.select("rank", "size", "n_blocks", "passes", "rest", "blocks"), "rank")
        whole = F.floor(F.col("size") / self.block_words)  # blocks of full size; a shorter one stands last
        turn = F.floor(F.col("draw") / F.col("n_blocks"))
        place = F.col("draw") - turn * F.col("n_blocks")
        block = F.when(place < whole, permuted(place, whole, self.seed, F.col("rank"), turn)).otherwise(place)
        words = F.least(F.lit(self.block_words), F.col("size") - block * self.block_words)
        cut = F.col("rest") - (F.col("blocks") - F.col("passes") * F.col("n_blocks") - 1) * self.block_words
        last = (F.col("draw") == F.col("blocks") - 1) & (F.col("rest") > 0)
        return drawn.select(
            "shard",
            F.xxhash64(self.seed, F.lit("order"), "rank", "draw").alias("order"),
            "rank",
            turn.alias("pass"),
            block.cast("bigint").alias("block"),
            F.when(last, F.least(words, cut)).otherwise(words).cast("bigint").alias("words"),
        )

    @cached_property
    def pieces(self) -> DataFrame:
        """What each draw takes of each document.

        shard and order place the draw; rank and first name the row of ``documents``;
        [from_word, to_word) are the words taken, counted from the document's start.
        """
        last = F.floor((F.col("first") + F.col("size") - 1) / self.block_words)
        spread = self.documents.where("size > 0").select(
            "rank", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / self.block_words), last)).alias("block")
        )
        begin = F.col("block") * self.block_words
        from_word = F.greatest(begin - F.col("first"), F.lit(0))
        to_word = F.least(F.col("size"), begin + F.col("words") - F.col("first"))
        return (
            spread.join(self.draws, ["rank", "block"])
            .select("shard", "order", "pass", "rank", "first", from_word.alias("from_word"), to_word.alias("to_word"))
            .where("from_word < to_word")
        )

    @property
    def taken(self) -> DataFrame:
        """id, source rank, size and taken words of every document."""
        sums = self.pieces.groupBy("rank", F.col("first").alias("place")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
        # Only one row with words begins at a place of a stream; rows without words match none.
        place = F.when(F.col("size") > 0, F.col("first"))
        return (
            self.documents.withColumn("place", place)
            .join(sums, ["rank", "place"], "left")
            .select("id", "rank", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
        )
