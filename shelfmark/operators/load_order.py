"""In which order records can be loaded, given the references between them.

A record's layer is one more than the highest layer it refers to; records of one layer can be
loaded together. Layers are found in rounds over written tables. A round hands the layers found
in the round before to the records that refer to them, and replaces each reference to a record
whose open references all lead to one other by a reference to that one (pointer doubling), so a
chain of any length takes as many rounds as its length has binary digits. A round costs one join
of the open references on what they refer to and one grouping of them; their number never grows.

What is left when a round finds nothing is on a cycle or refers to one. Run on the references
turned around, the same rounds leave only records on cycles or between two. Optional
references among these are put off, to be filled in once all is loaded, and the rounds go on.

Rounds work on 64-bit hashes of the keys; that no two keys share one is tested, and references
are compared by their keys before.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import fresh_dir


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = fresh_dir(df.sparkSession, label)
    # Hashes hardly repeat.
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Longer than any chain of records: only references on cycles, which nothing asks for, get there.
ENDLESS = 2**61
# At first, as long as the records found in a round are not one in so many of the open ones, but
# twice those of the round before, only the records that refer to them are looked at.
FEW = 100


def _sum(one: Column, other: Column) -> Column:
    return F.when(one + other > ENDLESS, F.lit(ENDLESS)).otherwise(one + other)


def _layers(keys: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(key, layer) of the keys that no cycle holds up, and the rounds it took.

    ``edges`` are (key, target) pairs between keys; ``keys`` may bring the ``least`` layer that
    other references ask for, in several rows of a key if need be.
    """
    none = F.lit(None).cast("bigint")
    nothing = F.lit(None).cast(edges.schema["target"].dataType)
    zero = F.lit(0).cast("bigint")

    def needs(records: DataFrame) -> DataFrame:
        return records.select("key", nothing.alias("target"), none.alias("steps"), "least")

    def by_record(told: DataFrame) -> DataFrame:
        return _stored(
            told.groupBy("key").agg(F.min("target").alias("next"), F.max("target").alias("last"), F.max("steps").alias("more"), F.max("least").alias("least")),
            "layers",
        )

    # Open references as (key, target, steps, -), what records are known to need as (key, -, -, least).
    told = edges.select("key", "target", F.lit(1).cast("bigint").alias("steps"), none.alias("least"))
    state = by_record(told.unionByName(needs(keys if "least" in keys.columns else keys.withColumn("least", zero))))
    found = [_stored(state.where("next IS NULL").select("key", "least"), "found")]
    n_found, n_open = found[-1].count(), state.where("next IS NOT NULL").count()
    rounds, before, following = 0, 0, True
    while n_found and n_open:
        rounds += 1
        waiting, open_edges = state.where("next IS NOT NULL"), told.where("target IS NOT NULL")
        following = following and n_found * FEW < n_open and n_found >= 2 * before
        if following:
            # Few that soon are more: only what refers to them is counted again.
            ended = found[-1].select(F.col("key").alias("target"), F.col("least").alias("below"))
            reached = open_edges.join(ended, "target").select("key", _sum(F.col("below"), F.col("steps")).alias("least"))
            reached = _stored(reached.groupBy("key").agg(F.max("least").alias("least")), "reached")
            told = open_edges.join(ended, "target", "left_anti").select("key", "target", "steps", "least")
            concerned = told.unionByName(needs(waiting)).join(reached.select("key"), "key", "left_semi")
            again = by_record(concerned.unionByName(needs(reached)))
            state = waiting.join(reached.select("key"), "key", "left_anti").unionByName(again)
            ready = again
        else:
            single = waiting.where("next = last").select(F.col("key").alias("target"), "next", "more", "least")
            # One whose only reference has just ended has its layer as well; no open reference may skip it.
            single = single.join(found[-1].select(F.col("key").alias("next"), F.col("least").alias("below")), "next", "left").select(
                "target", F.when(F.col("below").isNull(), F.col("next")).alias("next"), "more",
                F.when(F.col("below").isNull(), F.col("least")).otherwise(F.greatest("least", _sum(F.col("below"), F.col("more")))).alias("least"))
            ended = found[-1].select(F.col("key").alias("target"), nothing.alias("next"), none.alias("more"), "least")
            met = open_edges.drop("least").join(single.unionByName(ended), "target", "left")
            is_open = F.col("least").isNull() | F.col("next").isNotNull()
            told = _stored(
                met.select(
                    "key",
                    F.when(F.col("least").isNull(), F.col("target")).otherwise(F.col("next")).alias("target"),
                    F.when(is_open, _sum(F.col("steps"), F.coalesce("more", zero))).alias("steps"),
                    _sum(F.col("least"), F.col("steps")).alias("least"),
                ),
                "open-references",
            )
            state = ready = by_record(told.unionByName(needs(waiting)))
        found.append(_stored(ready.where("next IS NULL").select("key", "least"), "found"))
        before, n_found = n_found, found[-1].count()
        n_open -= n_found
    return _union(found).select("key", F.col("least").alias("layer")), rounds


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def _numbered(records: DataFrame, kind: str) -> tuple[DataFrame, int]:
    """(id, key) of the distinct keys with an id of each, and the seed of the hash that gives the ids."""
    for seed in count():
        key = F.col("key").cast(kind)
        keys = _stored(records.where("key IS NOT NULL").select(_hash(key, seed).alias("id"), key.alias("key")).distinct(), "keys")
        if keys.groupBy("id").count().where("count > 1").isEmpty():
            return keys, seed


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def load_layers(records: DataFrame, references: DataFrame) -> DataFrame:
    """key, layer, deferred and state of every record.

    ``records`` has a ``key``, ``references`` have ``key``, ``target`` and ``optional``. Null
    targets and targets that are no record hold nothing up. ``deferred`` counts the optional
    references to fill in afterwards. ``state`` is "ready", "cycle" for records on a cycle of
    references that are not optional (or between two such cycles), and "held" for those that
    need one of these; the last two have no layer. Repeated keys are one record.
    """
    given = records.select("key")
    kind = given.union(references.select("key")).union(references.select("target")).schema["key"].dataType.simpleString()
    keys, seed = _numbered(given, kind)
    known = references.where("key IS NOT NULL AND target IS NOT NULL").select(F.col("key").cast(kind).alias("from"), F.col("target").cast(kind).alias("to"), "optional")
    known = known.select("*", _hash(F.col("from"), seed).alias("key"), _hash(F.col("to"), seed).alias("target"))
    # By the hash, which sorts fast, and by the key itself. As each key is there once, these are
    # semi-joins; written as such, Spark would join every table that references come from on its own.
    known = known.join(keys.toDF("id", "own"), (F.col("target") == F.col("id")) & (F.col("to") == F.col("own"))).select("key", "from", "target", "optional")
    known = known.join(keys.toDF("id", "own"), (F.col("key") == F.col("id")) & (F.col("from") == F.col("own"))).select("key", "target", "optional")
    edges = _stored(known.groupBy("key", "target").agg(F.min("optional").alias("optional")), "references")
    off, found, held, open_edges = [], [], keys.select(F.col("id").alias("key")), edges
    asked = None
    while True:
        more, _ = _layers(held if asked is None else asked, open_edges.select("key", "target"))
        found.append(_stored(more, "layers"))
        if held.count() == found[-1].count():
            core = held.limit(0)
            break
        held = core = _stored(held.join(found[-1], "key", "left_anti"), "held")
        stuck = open_edges.join(found[-1], "key", "left_anti")
        stuck = _stored(stuck.join(found[-1].select(F.col("key").alias("target")), "target", "left_anti"), "stuck-references")
        if stuck.isEmpty():
            break
        turned = stuck.select(F.col("target").alias("key"), F.col("key").alias("target"))
        outside = _stored(_layers(held, turned)[0].select("key"), "between")
        core = _stored(held.join(outside, "key", "left_anti"), "cycles")
        put_off = stuck.where("optional").join(outside, "key", "left_anti").join(outside.select(F.col("key").alias("target")), "target", "left_anti")
        put_off = _stored(put_off.select("key", "target"), "deferred")
        if put_off.isEmpty():
            break
        off.append(put_off)
        kept = _stored(stuck.where("optional").join(put_off, ["key", "target"], "left_anti").select(stuck.columns), "references")
        open_edges = stuck.where("NOT coalesce(optional, false)").unionByName(kept)
        # What has its layer already is only a bound from here on.
        layers = _union(found)
        least = edges.join(layers.select(F.col("key").alias("target"), "layer"), "target").select("key", (F.col("layer") + 1).alias("least"))
        asked = held.withColumn("least", F.lit(0).cast("bigint")).unionByName(least.join(layers, "key", "left_anti"))
    own = keys.select(F.col("id"), F.col("key").cast(given.schema["key"].dataType).alias("key"))
    result = own.join(_union(found).toDF("id", "layer"), "id", "left").join(core.select(F.col("key").alias("id"), F.lit(True).alias("core")), "id", "left")
    state = F.when(F.col("layer").isNotNull(), "ready").when(F.col("core"), "cycle").otherwise("held")
    if not off:
        return result.select("key", "layer", F.lit(0).cast("bigint").alias("deferred"), state.alias("state"))
    counts = _union(off).groupBy(F.col("key").alias("id")).agg(F.count("*").alias("deferred"))
    return result.join(counts, "id", "left").select("key", "layer", F.coalesce("deferred", F.lit(0)).cast("bigint").alias("deferred"), state.alias("state"))
