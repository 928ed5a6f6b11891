"""Which source items an incremental import has to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the archive format: the mark of the end record, the length of that
# record, and the greatest length of the comment behind it.
ZIP_END_MARK = bytes.fromhex("504b0506")
ZIP_END_LENGTH = 22
ZIP_COMMENT_LENGTH = 65535


def is_zip(content: Column) -> Column:
    """True where the bytes end like a zip archive; null and cut archives are false.

    For the ``corrupt`` flag of local copies. Only the tail is searched, but Spark's
    binary source reads a file whole, so keep the flag in the inventory where files are big.
    """
    tail = ZIP_END_LENGTH + ZIP_COMMENT_LENGTH
    # The mark has to leave room for the rest of the end record.
    room = F.substring(content, -tail, tail - ZIP_END_LENGTH + len(ZIP_END_MARK))
    return F.coalesce(F.contains(room, F.lit(ZIP_END_MARK)), F.lit(False))


def ingest_plan(source: DataFrame, local: DataFrame, key: str = "item") -> DataFrame:
    """One action per source item: ``fetch``, ``copy``, ``skip`` or ``absent``.

    ``source``: key, ``source_time``, optionally ``is_file`` and ``exists`` for items
    with a ``file://`` address. ``local``: key (unique), ``local_time``, ``corrupt``.

    A missing or corrupt local copy is fetched. A source strictly older than the
    local copy is skipped; an equal or unknown time fetches. A ``file://`` source
    skips that test and is copied whenever it exists.

    The local columns are the joined side: Spark broadcasts it only below its size
    threshold, and splits a crowded source key when it shuffles.
    """
    copies = local.select(key, "local_time", "corrupt", F.lit(True).alias("has_local"))
    joined = source.join(copies, key, "left")
    is_file = F.coalesce(F.col("is_file"), F.lit(False)) if "is_file" in source.columns else F.lit(False)
    exists = F.coalesce(F.col("exists"), F.lit(True)) if "exists" in source.columns else F.lit(True)
    reason = (
        F.when(F.col("has_local").isNull(), "missing")
        .when(F.col("corrupt"), "corrupt")
        .when(is_file, "file source")
        .when(F.col("source_time") < F.col("local_time"), "older")
        .otherwise("updated")
    )
    action = (
        F.when(is_file & ~exists, "absent")
        .when(is_file, "copy")
        .when(F.col("reason") == "older", "skip")
        .otherwise("fetch")
    )
    return (
        joined.withColumn("reason", reason)
        .withColumn("action", action)
        .select(*source.columns, "action", "reason")
    )


def size_accepted(expected: Column, written: Column) -> Column:
    """A known size must have been written in full; size 0 or unknown accepts all."""
    return F.coalesce(expected == 0, F.lit(True)) | (expected == written)


def accepted_by_size(df: DataFrame, expected: str, written: str) -> DataFrame:
    return df.where(size_accepted(F.col(expected), F.col(written)))
