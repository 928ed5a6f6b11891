"""Restore a snapshot only after the present state is safe and both checksums hold."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shelfmark.functions.urls import rewrite_base_url
from shelfmark.operators.manifests import gate
from shelfmark.sources.snapshots import (
    new_snapshot_id,
    newest_snapshot,
    read_snapshot_table,
    verify_snapshot,
    write_snapshot,
)

POINTER_SCHEMA = "generation bigint, path string, tables array<string>"


class RestoreError(RuntimeError):
    """The restore stopped before anything was switched."""


class Restored(NamedTuple):
    """What a restore did: where the recovery snapshot is and which data is current."""

    recovery_root: str
    recovery_id: str
    source_id: str
    generation: int


# -- a store of tables with a pointer to the current generation -------------------

def _pointer(spark: SparkSession, store: str):
    pointers = spark.read.schema(POINTER_SCHEMA).parquet(f"{store}/pointer/*")
    return pointers.orderBy(F.desc("generation")).first()


def _switch(spark: SparkSession, store: str, generation: int, path: str, names: list[str]) -> None:
    row = spark.range(1).select(
        F.lit(generation).cast("bigint").alias("generation"),
        F.lit(path).alias("path"),
        F.array(*[F.lit(n) for n in names]).cast("array<string>").alias("tables"),
    )
    try:
        row.write.mode("errorifexists").parquet(f"{store}/pointer/{generation}")
    except AnalysisException as taken:
        raise RestoreError(f"generation {generation} of {store} is taken") from taken


def publish(spark: SparkSession, tables: dict[str, DataFrame], store: str, generation: int = 0) -> None:
    """Write tables to a path never used before, then point to it.

    Readers keep the former generation until the pointer row is there. A generation that is
    there already is never pointed to anew: the second of two rivals stops.
    """
    path = f"{store}/generation-{generation}-{new_snapshot_id()}"
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    _switch(spark, store, generation, path, list(tables))


def current_tables(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    at = _pointer(spark, store)
    return {name: spark.read.parquet(f"{at.path}/{name}") for name in at.tables}


# -- restore ------------------------------------------------------------------------

def _require_intact(spark: SparkSession, root: str, snapshot_id: str, message: str) -> None:
    verdict = gate(verify_snapshot(spark, root, snapshot_id, unlisted=False)).first()
    if not verdict.passed:
        raise RestoreError(f"{message} ({verdict.mismatch} wrong, {verdict.missing} missing)")


def checked_restore(
    spark: SparkSession,
    snapshots: str,
    store: str,
    source_url: str,
    target_url: str,
    now: datetime,
) -> Restored:
    """Snapshot the store, verify that, verify the newest source snapshot, load, rewrite, switch.

    The driver only sequences the jobs; what it reads back is one row per step. The
    loaded tables are written once, already rewritten, to a new path.
    """
    if not source_url or not target_url:
        raise RestoreError("both the source and the target address are needed")

    before = _pointer(spark, store)
    recovery_root = f"{snapshots}/{new_snapshot_id()}"
    recovery_id = write_snapshot(spark, current_tables(spark, store), recovery_root, now)
    _require_intact(spark, recovery_root, recovery_id, "the present state could not be saved")

    try:
        newest = newest_snapshot(spark, snapshots).first()
    except AnalysisException as missing:
        raise RestoreError(f"no snapshot in {snapshots}") from missing
    _require_intact(spark, snapshots, newest.path, "the checksums of the snapshot differ")

    loaded = {
        name: rewrite_base_url(
            read_snapshot_table(spark, snapshots, newest.path, name), source_url, target_url
        )
        for name in newest.tables
    }
    generation = before.generation + 1
    publish(spark, loaded, store, generation)
    return Restored(recovery_root, recovery_id, newest.path, generation)
