"""Load records by key into a stored table, rewriting only the files that hold replaced keys.

Layout below a store::

    files/<load>/part-*.parquet            rows, each file a range of keys
    manifests/<load>/*.parquet             the files of a generation, with least and greatest key
    pointer/<generation>                   which manifest is current

A load finds the files to rewrite in two steps: those whose range of keys meets the range of the
updates, by the manifest alone, and of these the ones that hold an updated key, by reading their
key column. The rows they keep and the updates go into new files; all other files stay in the
new manifest as they are. The pointer is switched last, so readers see the old table or the new.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.records import load_by_key
from shelfmark.plans.restore import _pointer, _switch
from shelfmark.sources.snapshots import new_snapshot_id

FILE = r"files/[^/]+/[^/]+$"


def _written(rows: DataFrame, store: str, load: str, key: str) -> DataFrame:
    """Write rows by ranges of their key; file, least, most and n of each file that holds any."""
    path = f"{store}/files/{load}"
    rows.repartitionByRange(F.col(f"`{key}`")).write.parquet(path)
    read = rows.sparkSession.read.schema(rows.schema).parquet(path)
    file = F.regexp_extract("_metadata.file_path", FILE, 0).alias("file")
    own = F.col(f"`{key}`")
    return read.groupBy(file).agg(F.min(own).alias("least"), F.max(own).alias("most"), F.count("*").alias("n"))


def create_store(table: DataFrame, store: str, key: str) -> None:
    """Write a table as the first generation of a store."""
    load = new_snapshot_id()
    manifest = f"{store}/manifests/{load}"
    _written(table, store, load, key).write.parquet(manifest)
    _switch(table.sparkSession, store, 0, manifest, [key])


def manifest_of(spark: SparkSession, store: str) -> DataFrame:
    """file, least, most and n of the current files."""
    return spark.read.parquet(_pointer(spark, store).path)


def _rows_of(spark: SparkSession, store: str, files: DataFrame, schema) -> DataFrame:
    """Rows of the listed files; the reader wants their names, one for each file."""
    paths = [f"{store}/{r.file}" for r in files.select("file").toLocalIterator()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The current table."""
    manifest = manifest_of(spark, store)
    first = manifest.select("file").first()
    if first is None:
        raise ValueError(f"nothing is stored in {store}")
    return _rows_of(spark, store, manifest, spark.read.parquet(f"{store}/{first.file}").schema)


def merge_into_store(spark: SparkSession, store: str, loads: Sequence[DataFrame], position: Sequence[str] = ()) -> int:
    """Load tables one after another into the store; the later record replaces the whole earlier one.

    Rows without a key replace nothing and are added. Returns the number of files rewritten.
    """
    at = _pointer(spark, store)
    key = at.tables[0]
    own = F.col(f"`{key}`")
    load = new_snapshot_id()
    columns = read_store(spark, store).columns
    staged = f"{store}/staged/{load}"
    load_by_key(loads, [key], position).select(*[f"`{c}`" for c in columns]).write.parquet(staged)
    updates = spark.read.parquet(staged)
    keys = updates.select(own.alias("updated")).where("updated IS NOT NULL")
    least, most = keys.agg(F.min("updated"), F.max("updated")).first()

    manifest = spark.read.parquet(at.path)
    near = manifest.where((F.col("most") >= F.lit(least)) & (F.col("least") <= F.lit(most))) if least is not None else manifest.limit(0)
    candidates = _rows_of(spark, store, near, updates.schema)
    in_range = candidates.where(own.between(F.lit(least), F.lit(most))) if least is not None else candidates.where(F.lit(False))
    file = F.regexp_extract("_metadata.file_path", FILE, 0).alias("file")
    touched = in_range.select(own.alias("updated"), file) if least is not None else None
    if touched is None:
        rewritten = manifest.select("file").limit(0)
    else:
        path = f"{store}/touched/{load}"
        touched.join(keys, "updated", "left_semi").select("file").distinct().write.parquet(path)
        rewritten = spark.read.parquet(path)
    kept = _rows_of(spark, store, rewritten, updates.schema).join(keys, own == F.col("updated"), "left_anti")
    fresh = _written(kept.unionByName(updates), store, load, key)
    target = f"{store}/manifests/{load}"
    manifest.join(rewritten, "file", "left_anti").select("file", "least", "most", "n").unionByName(fresh).write.parquet(target)
    _switch(spark, store, at.generation + 1, target, [key])
    return rewritten.count()
