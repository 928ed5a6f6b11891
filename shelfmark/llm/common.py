"""What the operators of this subpackage share: stored tables, text batches, folds over spans."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import fresh_dir

#: Path-free names of the public vocabularies that the token operators take by default.
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    That is enough where they share its disk; on a cluster the package is installed or
    shipped as any other.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """Where an installed public vocabulary lies; pass any other path to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives lost executors."""
    workers_find_package(df.sparkSession)
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Numbered:
    """A table with its columns named by position, so that no work column can clash with one.

    Names may hold dots, repeat work names or differ in case alone; ``back`` restores them.
    """

    def __init__(self, documents: DataFrame):
        self.columns = documents.columns
        self.names = [f"c{i}" for i in range(len(self.columns))]
        self.rows = documents.toDF(*self.names)

    def __contains__(self, column: str) -> bool:
        return column in self.columns

    def name(self, column: str) -> str:
        """The name by position of a column."""
        return self.names[self.columns.index(column)]

    def back(self, rows: DataFrame, *more: Column, without: tuple[str, ...] = ()) -> DataFrame:
        """The columns under their own names, and more after them."""
        kept = [F.col(n).alias(c) for n, c in zip(self.names, self.columns) if c not in without]
        return rows.select(*kept, *more)


def slices(texts: pd.Series, chars: int) -> Iterator[list[str]]:
    """The texts of a batch in order, null as empty, in runs of about so many characters."""
    run: list[str] = []
    size = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        run.append(text)
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def covered(spans: Column) -> Column:
    """Positions inside at least one of the spans (structs that begin with start and end)."""
    start = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))

    def add(seen: Column, span: Column) -> Column:
        since = F.greatest(span["start"].cast("long"), seen["reach"])
        return F.struct(
            F.greatest(span["end"].cast("long"), seen["reach"]).alias("reach"),
            (seen["n"] + F.greatest(span["end"].cast("long") - since, F.lit(0).cast("long"))).alias("n"),
        )

    return F.aggregate(F.array_sort(spans), start, add, lambda seen: seen["n"])
