"""Load record files in order, as a deployment does at its first start."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators.records import load_by_key
from shelfmark.sources.records import read_records


def load_record_files(
    spark: SparkSession, paths: Sequence[str], *, array_files: bool = True
) -> DataFrame:
    """Records of all files; a later file, or a later record in a file, replaces by model and pk."""
    loads = [
        read_records(spark, path, array_files=array_files, positions=True) for path in paths
    ]
    return load_by_key(loads, ["model", "pk"], ["position"])
