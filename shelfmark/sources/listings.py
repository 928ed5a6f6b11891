"""File listings and bulk import by kind.

A listing is a DataFrame of ``path``, ``mtime`` and ``size``. It comes from a folder,
or from an inventory table when there are too many files to list at query time; the
operators do not care which.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import fresh_dir

# Kinds that have a subfolder of their own.
KINDS = ("vector", "raster", "time")

_SCHEME_AND_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?"


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """All files below ``root``. The content column is not read, so no file is opened.

    Spark's file sources pass over empty files; where those matter, use an inventory table.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select(
        "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")
    )


def kind_of_path(path: Column) -> Column:
    """The known kind whose folder a relative path starts with; null where there is none."""
    found = F.regexp_extract(path, rf"^({'|'.join(KINDS)})/", 1)
    return F.nullif(found, F.lit(""))


def import_root(root: str, kind: str | None = None) -> str:
    """The folder of a known kind; any other value means the whole root."""
    return f"{root.rstrip('/')}/{kind}" if kind in KINDS else root


def list_by_kind(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """Files to import. Only the folder of a known kind is listed at all."""
    below = relative_path(F.col("path"), root)
    return list_files(spark, import_root(root, kind)).withColumn("kind", kind_of_path(below))


def import_by_kind(
    spark: SparkSession, root: str, kind: str | None = None, *, schema=None, source: str = "parquet"
) -> DataFrame:
    """Rows of all files of one kind, or of the whole root, with the kind of their folder.

    Without a schema the columns of all files are merged, so that no kind hides another's.
    """
    reader = spark.read.format(source).option("recursiveFileLookup", True)
    reader = reader.option("mergeSchema", True) if schema is None else reader.schema(schema)
    rows = reader.load(import_root(root, kind))
    # The metadata path is URL-encoded, other than the path of a listing.
    below = relative_path(F.url_decode("_metadata.file_path"), root)
    return rows.select("*", kind_of_path(below).alias("kind"))


def file_digests(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """md5 per file below ``root``, with the path relative to it.

    A file is one row here and has to fit a task, so writers bound their file size;
    a larger one fails the read, it is never cut.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select(
        relative_path(F.col("path"), root).alias("path"), F.md5("content").alias("md5")
    )


# -- every file, whatever its name and size --------------------------------------------

WALKED = "path string, mtime timestamp, size bigint"
CHUNK = 1 << 20
#: Entries that a task lists before it hands back the folders it has not opened.
WALK_BUDGET = 20_000


def walk_files(spark: SparkSession, root: str, pattern: str | None = None, budget: int = WALK_BUDGET) -> DataFrame:
    """All files below ``root`` with their paths below it: empty and hidden ones too.

    The folders known so far are dealt out to tasks. A task opens folder after folder, those it
    finds included, until it has seen ``budget`` entries, and hands the folders it has not
    opened back to be dealt out again; each such round is written. So a small tree takes one
    round, a deep or a lopsided one is spread anew in each, and the driver lists nothing.

    ``root`` must be of a store that Arrow opens (a plain path, s3, gs, hdfs); one folder is
    listed by one task. ``pattern`` is a shell-style pattern for the last part of the path.
    """
    store, base = fs.FileSystem.from_uri(root.rstrip("/"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for batch in batches:
            folders = batch["path"].tolist()
            while folders and seen < budget:
                infos = store.get_file_info(fs.FileSelector(folders.pop()))
                seen += 1 + len(infos)
                folders += [i.path for i in infos if i.type == fs.FileType.Directory]
                files = [i for i in infos if i.type == fs.FileType.File and (pattern is None or fnmatchcase(i.base_name, pattern))]
                for first in range(0, len(files), WALK_BUDGET):  # a crowded folder goes out in pieces
                    yield listed(files[first : first + WALK_BUDGET])
            unopened = pd.DataFrame({"path": folders, "size": 0, "folder": True})
            yield unopened.assign(mtime=pd.to_datetime([None] * len(folders), utc=True)).astype(kinds)[list(kinds)]

    kinds = {"path": object, "mtime": "datetime64[ns, UTC]", "size": "int64", "folder": bool}

    def listed(infos: list[fs.FileInfo]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "path": [i.path[len(base) + 1 :] for i in infos],
                "mtime": pd.to_datetime([i.mtime for i in infos], utc=True),
                "size": [i.size for i in infos],
                "folder": False,
            }
        ).astype(kinds)

    folders = spark.createDataFrame([(base,)], "path string")
    rounds: list[DataFrame] = []
    while not rounds or not folders.isEmpty():
        target = fresh_dir(spark, "walk")
        folders.repartition("path").mapInPandas(walk, f"{WALKED}, folder boolean").write.parquet(target)
        rounds.append(spark.read.schema(f"{WALKED}, folder boolean").parquet(target))
        folders = rounds[-1].where("folder").select("path")
    return reduce(DataFrame.unionByName, rounds).where("NOT folder").drop("folder")


def streamed_digests(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """md5 of every file that :func:`walk_files` sees, read in pieces: no bound on its size."""
    store, base = fs.FileSystem.from_uri(root.rstrip("/"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                md5 = hashlib.md5()
                with store.open_input_stream(f"{base}/{path}") as stream:
                    while piece := stream.read(CHUNK):
                        md5.update(piece)
                yield pd.DataFrame({"path": [path], "md5": [md5.hexdigest()]})

    files = walk_files(spark, root, pattern).select("path").repartition("path")
    return files.mapInPandas(digest, "path string, md5 string")


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``, which is absolute; scheme and host may be written or left out."""
    base = re.sub("/+", "/", re.sub(_SCHEME_AND_HOST, "", root.rstrip("/")))
    if not base.startswith("/") and base:
        raise ValueError(f"not an absolute path: {root!r}")
    plain = F.regexp_replace(path, _SCHEME_AND_HOST, "")
    return F.substring(plain, F.lit(len(base) + 2), F.length(plain))
