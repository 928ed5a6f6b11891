"""Keyed loading of records and the references between record tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The whole row with the greatest ``order`` per key; rows with a null in a key all stay.

    A record without a key replaces nothing and is replaced by nothing. The rank is cut
    within each task before the exchange, so a key that is loaded over and over sends one
    row per task. Equal orders are settled by a hash of the row, not by task order.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    latest = Window.partitionBy(*keys).orderBy(
        *[F.col(o).desc() if isinstance(o, str) else o.desc() for o in order], F.xxhash64(*_atomic(df)).desc()
    )
    ranked = df.where(known).withColumn("__rank", F.row_number().over(latest))
    return ranked.where("__rank = 1").drop("__rank").unionByName(df.where(~known))


def load_by_key(
    loads: Sequence[DataFrame], keys: Sequence[str], position: Sequence[str] = ()
) -> DataFrame:
    """Load record tables one after another; the later record replaces the whole earlier one.

    ``position`` names columns that order the rows within a load; they are dropped from
    the result. A load without them has each key once.

    The first load is only aggregated if it has positions: the later loads are reduced
    to one row per key and the replaced rows are taken out by an anti join, so that a
    large base with small updates is neither sorted nor, when the keys fit a broadcast,
    shuffled.
    """
    base, *updates = (_last_in_load(load, keys, position) for load in loads)
    if not updates:
        return base
    merged = updates[0]
    if len(updates) > 1:
        numbered = [u.withColumn("load_no", F.lit(i)) for i, u in enumerate(updates)]
        merged = last_per_key(reduce(DataFrame.unionByName, numbered), keys, ["load_no"])
        merged = merged.drop("load_no")
    kept = base.join(merged.select(*keys), list(keys), "left_anti")
    return kept.select(*base.columns).unionByName(merged)


def _last_in_load(load: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    placed = [c for c in position if c in load.columns]
    return last_per_key(load, keys, placed).drop(*placed) if placed else load


def _atomic(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, nested)]


def resolve_reference(
    referring: DataFrame,
    referred: DataFrame,
    reference: Column,
    key: str,
    take: Mapping[str, str],
    optional: bool = False,
) -> DataFrame:
    """Join columns of the referred record by its key.

    ``take`` maps new column names to columns of ``referred``. A natural key is a
    reference like any other: ``F.col("user")[0]`` against the user name. Without
    ``optional`` rows whose reference is null or unknown drop out; with it they stay,
    with nulls. Spark broadcasts the referred side when it is below the threshold.

    Rows with a null reference match nothing, so they take no part in the join and in its
    shuffle; where they stay, they are put back beside it.
    """
    target = referred.select(
        F.col(key).alias("__key"), *[F.col(old).alias(new) for new, old in take.items()]
    )
    left = referring.withColumn("__reference", reference).where(F.col("__reference").isNotNull())
    joined = left.join(target, F.col("__reference") == F.col("__key"), "left" if optional else "inner")
    found = joined.select(*referring.columns, *take)
    if not optional:
        return found
    empty = [F.lit(None).cast(target.schema[new].dataType).alias(new) for new in take]
    return found.unionByName(referring.where(reference.isNull()).select("*", *empty))


def dangling_references(
    referring: DataFrame, referred: DataFrame, reference: Column, key: str
) -> DataFrame:
    """Rows that refer to a record that does not exist; a null reference is none."""
    target = referred.select(F.col(key).alias("__key"))
    left = referring.withColumn("__reference", reference).where(F.col("__reference").isNotNull())
    missing = left.join(target, F.col("__reference") == F.col("__key"), "left_anti")
    return missing.select(*referring.columns)
