"""Expiry rules over file listings, and the newest file per folder."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.values import utc_instant
from shelfmark.operators.selection import time_literal
from shelfmark.session import fresh_dir

# Up to this many rows per group Spark cuts a ranked group before the exchange.
GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"
# Sorts before, and after all of, what can follow a folder's path: a path holds no zero character.
BELOW, BEYOND = "\0", "\1"
# Into how many parts a folder is dealt where more rows than that are spared.
PARTS = 1024


def older_than_days(df: DataFrame, column: str, days: int, now: datetime) -> Column:
    """Age in whole days above ``days``.

    Whole days are cut, so "above 30" starts at 31 full days. Written as a bound on
    the column itself, which the scan can use.
    """
    return F.col(column) <= time_literal(df.schema[column].dataType, now - timedelta(days=days + 1))


def expired_files(
    listing: DataFrame,
    now: datetime,
    *,
    days: int = 30,
    keep: int = 3,
    keep_scope: str = "expired",
    folder: str = "folder",
    path: str = "path",
    mtime: str = "mtime",
    root: str | None = None,
    kind: str = "kind",
) -> DataFrame:
    """Files to delete: older than ``days``, with the newest ``keep`` per folder spared.

    With ``root`` only plain files directly in that folder count, hidden ones included;
    rows whose ``kind`` (where the listing has one) is not "f" and files further down are
    never returned.

    ``keep_scope="expired"`` spares the newest of the expired files, ``"all"`` the
    newest of all files. Equal times fall to the greater path. A path must be unique
    in its folder.

    The rank filter leaves at most ``keep`` rows per folder in every task before the
    exchange, so a folder that holds most files stays spread out; where that is more than
    Spark cuts there, parts of a folder are ranked first. The spared are then taken out by
    path, which spreads evenly too.
    """
    if keep_scope not in ("expired", "all"):
        raise ValueError(f"keep_scope is 'expired' or 'all', not {keep_scope!r}")
    if root is not None:
        plain = F.col(kind) == "f" if kind in listing.columns else F.lit(True)
        listing = listing.where(directly_in(F.col(path), root) & plain)
        folder = "__root"
        listing = listing.withColumn(folder, F.lit(root))
    columns = [c for c in listing.columns if c != "__root"]
    expired = listing.where(older_than_days(listing, mtime, days, now))
    if keep <= 0:
        return expired.select(*columns)
    newest = [F.desc(mtime), F.desc(path)]
    files = (expired if keep_scope == "expired" else listing).select(folder, path, mtime)
    if keep > int(listing.sparkSession.conf.get(GROUP_LIMIT_SETTING)):
        part = F.pmod(F.xxhash64(path), F.lit(PARTS))
        files = files.withColumn("rank", F.row_number().over(Window.partitionBy(folder, part).orderBy(*newest)))
        files = files.where(F.col("rank") <= keep)
    newest_first = Window.partitionBy(folder).orderBy(*newest)
    spared = (
        files.withColumn("rank", F.row_number().over(newest_first))
        .where(F.col("rank") <= keep)
        .select(F.col(folder).alias("spared_folder"), F.col(path).alias("spared_path"))
    )
    same = F.col(folder).eqNullSafe(F.col("spared_folder")) & (F.col(path) == F.col("spared_path"))
    return expired.join(spared, same, "left_anti").select(*columns)


def directly_in(path: Column, root: str) -> Column:
    """True for paths one step below ``root``, whatever their name."""
    base = root.rstrip("/") + "/"
    return path.startswith(base) & path.rlike("[^/]$") & (F.instr(F.substring(path, len(base) + 1, 1 << 30), "/") == 0)


def expired_dirs(
    listing: DataFrame,
    now: datetime,
    *,
    days: int = 30,
    kind: str = "kind",
    ctime: str = "ctime",
) -> DataFrame:
    """Directories of any depth whose change time is older than ``days``; none is spared."""
    return listing.where((F.col(kind) == "d") & older_than_days(listing, ctime, days, now))


def expired_trees(
    listing: DataFrame,
    now: datetime,
    *,
    days: int = 30,
    path: str = "path",
    kind: str = "kind",
    ctime: str = "ctime",
) -> DataFrame:
    """Everything that goes with the expired directories: they and all that lies below them.

    With the separator sorted before every other character, all that lies below a directory
    follows it without a gap, so each expired directory is an interval of paths, and intervals
    lie apart or inside one another. A path is inside one exactly if an interval that began at
    or before it reaches beyond it. The listing is dealt into ranges of paths and written once;
    the furthest reach runs along each range, and along the ranges by one row each. Depth adds
    no rows, and a directory with most of the listing below it is as many ranges as any other
    paths. A fresh file in an old directory goes too; a null path stays.
    """
    names = [f"c{i}" for i in range(len(listing.columns))]  # no work column can clash with these
    rows = listing.toDF(*names)
    name = dict(zip(listing.columns, names))
    inside = F.replace(F.regexp_replace(F.col(name[path]), "/+$", ""), F.lit("/"), F.lit(BELOW))
    old = (F.col(name[kind]) == "d") & older_than_days(rows, name[ctime], days, now)
    keyed = rows.where(F.col(name[path]).isNotNull()).select(
        "*", inside.alias("key"), F.when(old, F.concat(inside, F.lit(BEYOND))).alias("reach")
    )
    covered = covered_by_intervals(keyed).where("covered")
    return covered.select(*[F.col(n).alias(c) for c, n in name.items()])


def covered_by_intervals(rows: DataFrame) -> DataFrame:
    """The rows with ``covered``: whether an interval from a ``key`` to its ``reach`` holds the row's key.

    Intervals are rows with a reach; they lie apart or inside one another.
    """
    ranged = rows.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    target = fresh_dir(rows.sparkSession, "path-ranges")
    ranged.write.parquet(target)
    ranged = rows.sparkSession.read.schema(ranged.schema).parquet(target)
    earlier = F.max("reach").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = ranged.groupBy("part").agg(F.max("reach").alias("reach")).select("part", earlier.alias("earlier"))
    # Equal keys are peers: an interval covers its own row, wherever that stands.
    so_far = F.max("reach").over(Window.partitionBy("part").orderBy("key"))
    furthest = F.greatest("so_far", "earlier")
    covered = ranged.withColumn("so_far", so_far).join(parts, "part").withColumn("covered", F.coalesce(furthest > F.col("key"), F.lit(False)))
    return covered.drop("part", "so_far", "earlier")


def within_ttl(df: DataFrame, column: str, now: datetime, days: int = 7) -> DataFrame:
    """Rows not older than the time to live."""
    return df.where(F.col(column) >= time_literal(df.schema[column].dataType, now - timedelta(days=days)))


def direct_file(path: Column, folder: Column, extension: str = ".zip") -> Column:
    """True for a visible file of that extension directly in ``folder``."""
    name = F.substring_index(path, "/", -1)
    return (
        F.endswith(path, F.lit(extension))
        & (path == F.concat(folder, F.lit("/"), name))
        & ~F.startswith(name, F.lit("."))
    )


def latest_per_folder(
    listing: DataFrame, *, folder: str = "folder", path: str = "path", mtime: str = "mtime"
) -> DataFrame:
    """Newest path per folder by whole seconds; equal seconds fall to the greater path.

    A maximum folds within each task first, so one crowded folder is no burden.
    """
    seconds = F.unix_seconds(utc_instant(listing, mtime))
    newest = F.max(F.struct(seconds.alias("second"), F.col(path).alias("path")))
    return (
        listing.groupBy(folder)
        .agg(newest.alias("newest"))
        .select(folder, F.col("newest.path").alias(path), F.col("newest.second").alias("mtime_second"))
    )
