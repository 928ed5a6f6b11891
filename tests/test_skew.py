"""Joins, upserts, ranks and aggregates on tables where one key holds a third of the rows.

The tables come as several files each, broadcasts are off and the thresholds are so small
that Spark treats the hot key as it would on a cluster.
"""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import SF_DIR, TABLES, by_name

import __spark_entry__ as registry

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "30KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}
# Column that turns hot for every third row of a table, with its one value.
HOT = {
    "orders": ("o_orderkey", "o_custkey", 1),
    "lineitem": ("l_orderkey", "l_partkey", 1),
    "events": ("event_id", "user_id", 1),
    "documents": ("doc_id", "source", "src1"),
}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("skewed"))
    for name in TABLES:
        rows = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        if name in HOT:
            key, column, value = HOT[name]
            hot = F.when(F.col(key) % 3 == 0, F.lit(value)).otherwise(F.col(column))
            rows = rows.withColumn(column, hot.cast(rows.schema[column].dataType))
        if name == "events":
            rows = rows.withColumn("event_type", F.when(F.col("event_id") % 3 == 0, "view").otherwise(F.col("event_type")))
        rows.repartition(5).write.parquet(f"{base}/{name}.parquet")
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield base
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize(
    "name",
    [
        "resource_counts", "fixture_upsert", "fixture_upsert_unkeyed", "retention_depth", "retention_dirs_cascade", "fk_resolve", "fk_natural", "fk_nullable", "fk_dangling",
        "manifest_verify", "table_fingerprint", "latest_snapshot", "retention_expire",
        "retention_expire_all", "ingest_plan", "monitor_windows", "monitor_windows_stream",
        "snapshot_contents", "checked_restore", "import_by_kind", "fixture_times",
    ],
)
def test_same_rows_as_sql_on_skewed_tables(spark, skewed, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{skewed}/{table}.parquet/*.parquet'")
    cursor = duck.execute(registry.oracle_sql()[name])
    wanted = by_name([d[0] for d in cursor.description], cursor.fetchall())
    result = registry.queries()[name](spark, skewed)
    assert by_name(result.columns, [tuple(r) for r in result.collect()]) == wanted
