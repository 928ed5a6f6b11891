"""Dated snapshots of tables with a checksum manifest.

Layout below a snapshot root::

    <root>/<snapshot id>/data/<table>/*.parquet
    <root>/<snapshot id>/manifest/*.txt            checksum lines, paths below data
    <root>/catalog/*.parquet                       one row per finished snapshot

The catalogue row is written last: a snapshot that a lost driver left half written is
never seen by readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.manifests import manifest_lines, parse_manifest_lines, verify_manifest
from shelfmark.operators.retention import latest_per_folder
from shelfmark.operators.selection import time_literal
from shelfmark.sources.listings import file_digests

CATALOG_SCHEMA = "path string, mtime timestamp, tables array<string>"

# Greatest number of rows per data file. A file is hashed as a whole, so it must not grow
# without bound; what a task reads at once mostly keeps it far smaller.
ROWS_PER_FILE = 4_000_000


def new_snapshot_id() -> str:
    return uuid.uuid4().hex


def select_tables(tables: Mapping[str, DataFrame], apps: Sequence[str] | None) -> dict[str, DataFrame]:
    """Tables named ``app.model`` whose app is listed; all when no list is given."""
    return {
        name: table
        for name, table in tables.items()
        if apps is None or name.split(".")[0] in apps
    }


def write_snapshot(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    root: str,
    now: datetime,
    *,
    apps: Sequence[str] | None = None,
    snapshot_id: str | None = None,
    rows_per_file: int = ROWS_PER_FILE,
    digests: Callable[..., DataFrame] | None = None,
) -> str:
    """Write the tables, then their manifest, then the catalogue row. Returns the id.

    ``digests`` hashes files: by default Spark's reader, which opens any store and holds a
    file whole; :func:`listings.streamed_digests` has no bound on the size of a file.
    """
    snapshot_id = snapshot_id or new_snapshot_id()
    chosen = select_tables(tables, apps)
    if not chosen:
        raise ValueError("no table belongs to the listed apps")
    base = f"{root}/{snapshot_id}"
    for name, table in chosen.items():
        table.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{base}/data/{name}")
    made = (digests or file_digests)(spark, f"{base}/data", "*.parquet")
    manifest_lines(made).write.text(f"{base}/manifest")
    row = spark.range(1).select(
        F.lit(snapshot_id).alias("path"),
        time_literal(T.TimestampType(), now).alias("mtime"),
        F.array(*[F.lit(n) for n in chosen]).cast("array<string>").alias("tables"),
    )
    row.write.mode("append").parquet(f"{root}/catalog")
    return snapshot_id


def read_manifest(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    return parse_manifest_lines(spark.read.text(f"{root}/{snapshot_id}/manifest"))


def read_snapshot_table(spark: SparkSession, root: str, snapshot_id: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{snapshot_id}/data/{table}")


def verify_snapshot(
    spark: SparkSession,
    root: str,
    snapshot_id: str,
    unlisted: bool = True,
    digests: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """Hash the files again and compare them with the manifest."""
    actual = (digests or file_digests)(spark, f"{root}/{snapshot_id}/data", "*.parquet")
    return verify_manifest(actual, read_manifest(spark, root, snapshot_id), unlisted=unlisted)


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).parquet(f"{root}/catalog")


def newest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest finished snapshot directly in ``root``, with its table names; one row.

    Snapshots below a subfolder have a catalogue of their own and do not count.
    """
    catalog = read_catalog(spark, root)
    newest = latest_per_folder(catalog.withColumn("folder", F.lit(root))).select("path")
    return catalog.join(newest, "path", "left_semi").select("path", "tables")
