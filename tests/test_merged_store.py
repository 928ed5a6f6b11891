"""The stored merge against the plain load, and the files it leaves alone."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfmark.plans import merged_store
from shelfmark.plans.restore import RestoreError, _switch

SCHEMA = "`pk` bigint, name string, file string"


@pytest.fixture
def stored(spark, tmp_path):
    """A store of 2,000 keys in ten files."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    base = spark.range(2000).select(F.col("id").alias("pk"), F.concat(F.lit("n"), "id").alias("name"), F.lit("f").alias("file"))
    merged_store.create_store(base, str(tmp_path / "store"), "pk")
    yield base, str(tmp_path / "store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
    spark.conf.set("spark.sql.shuffle.partitions", before[1])


def files(spark, store):
    return {r.file: hashlib.md5(Path(store, r.file).read_bytes()).hexdigest() for r in merged_store.manifest_of(spark, store).collect()}


def rows(df):
    return sorted(map(str, df.collect()))


def test_only_files_with_replaced_keys_are_rewritten(spark, stored):
    base, store = stored
    before = files(spark, store)
    assert len(before) == 10
    updates = spark.createDataFrame([(3, "new", "u"), (5, None, "u"), (1999, "last", "u"), (5000, "added", "u")], SCHEMA)
    assert merged_store.merge_into_store(spark, store, [updates]) == 2
    after = files(spark, store)
    same = set(before) & set(after)
    assert len(same) == 8 and all(before[f] == after[f] for f in same)
    assert rows(merged_store.read_store(spark, store)) == rows(plain(base, updates))
    assert all(hashlib.md5(Path(store, f).read_bytes()).hexdigest() == m for f, m in before.items())  # old readers go on


def plain(base, *updates):
    out = base
    for u in updates:
        out = out.join(u.select(F.col("`pk`").alias("k")), F.col("`pk`") == F.col("k"), "left_anti").unionByName(u)
    return out


def test_keys_between_those_there_touch_no_file(spark, stored):
    base, store = stored
    sparse = base.where("`pk` % 2 = 0")
    merged_store.create_store(sparse, store + "2", "pk")
    before = files(spark, store + "2")
    odd = spark.createDataFrame([(7, "odd", "u"), (None, "no key", "u"), (None, "no key", "u")], SCHEMA)
    assert merged_store.merge_into_store(spark, store + "2", [odd]) == 0
    assert set(before) <= set(files(spark, store + "2"))
    assert rows(merged_store.read_store(spark, store + "2")) == rows(sparse.unionByName(odd))


def test_loads_follow_each_other(spark, stored):
    base, store = stored
    one = spark.createDataFrame([(10, "one", "u"), (11, "one", "u")], SCHEMA)
    two = spark.createDataFrame([(11, "two", "u"), (12, "two", "u")], SCHEMA)
    merged_store.merge_into_store(spark, store, [one])
    merged_store.merge_into_store(spark, store, [two, two.where(F.lit(False))])
    assert rows(merged_store.read_store(spark, store)) == rows(plain(base, one, two))
    with pytest.raises(RestoreError):  # a rival that was as far as the first load
        _switch(spark, store, 1, "elsewhere", ["pk"])
