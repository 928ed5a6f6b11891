"""Catalogue counts and per-minute metric windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_wide(df: DataFrame, kinds: Sequence[str], column: str = "kind") -> DataFrame:
    """One row with one count per known kind, 0 where a kind has no row.

    Every task folds its rows to a single row before the exchange, so neither the
    number of rows nor a kind that holds most of them matters.
    """
    return df.agg(*[F.count_if(F.col(column) == kind).alias(kind) for kind in kinds])


def resource_counts(
    df: DataFrame, kinds: Sequence[str], column: str = "kind", count: str = "n"
) -> DataFrame:
    """One row per known kind with its count, 0 where it has no row."""
    pairs = [
        F.struct(F.lit(kind).alias(column), F.col(f"`{kind}`").alias(count)) for kind in kinds
    ]
    return counts_wide(df, kinds, column).select(F.inline(F.array(*pairs)))


def metric_windows(
    df: DataFrame,
    *,
    time: str = "ts",
    service: str = "service",
    value: str = "value",
    width: str = "1 minute",
) -> DataFrame:
    """Count, sum, least and greatest value per window and service.

    The partial aggregation before the exchange keeps a busy service small. Sums are taken
    over decimals of nine digits, so that the order of the parts does not matter; only
    values too great for that, infinite or not a number are summed as they are.
    """
    exact = F.sum(F.col(value).try_cast("decimal(28,9)")).cast("double")
    small = F.greatest(F.abs(F.max(value)), F.abs(F.min(value))) < 1e15
    return (
        df.groupBy(F.window(time, width).alias("w"), F.col(service))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.when(small, exact).otherwise(F.sum(value)).alias("total"),
            F.min(value).alias("least"),
            F.max(value).alias("greatest"),
        )
        .select(F.col("w.start").alias("window_start"), service, "n", "total", "least", "greatest")
    )
