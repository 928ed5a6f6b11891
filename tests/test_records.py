from datetime import datetime, timedelta

import pytest
from helpers import executed_plan
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.operators import records


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


# -- keyed loading ------------------------------------------------------------------

def test_later_record_replaces_the_whole_earlier_one(spark):
    schema = "model string, pk long, a string, b string"
    first = spark.createDataFrame([("m", 1, "x", "y"), ("m", 2, "x", "y"), ("n", 1, "x", None)], schema)
    second = spark.createDataFrame([("m", 1, None, "z")], schema)
    third = spark.createDataFrame([("m", 1, "last", None), ("m", 3, "new", None)], schema)
    out = records.load_by_key([first, second, third], ["model", "pk"])
    assert {(r.model, r.pk): (r.a, r.b) for r in out.collect()} == {
        ("m", 1): ("last", None),
        ("m", 2): ("x", "y"),
        ("m", 3): ("new", None),
        ("n", 1): ("x", None),
    }
    assert records.load_by_key([first], ["model", "pk"]).count() == 3


def test_records_without_a_key_are_all_kept(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b")], "pk long, v string")
    assert pairs(records.load_by_key([df, df.limit(1)], ["pk"]).select("v")) == [("a",), ("a",), ("b",)]


def test_made_up_loads_with_positions(spark):
    row = st.tuples(st.integers(0, 5), st.sampled_from(["a", "b", None]))
    loads = st.lists(st.lists(row, max_size=8), min_size=1, max_size=4)

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(loads)
    def check(made):
        wanted = {pk: v for load in made for pk, v in load}
        frames = [
            spark.createDataFrame([(pk, v, i) for i, (pk, v) in enumerate(load)], "pk int, v string, at int")
            for load in made
        ]
        out = records.load_by_key(frames, ["pk"], ["at"])
        assert out.columns == ["pk", "v"]
        rows = out.collect()
        assert len(rows) == len(wanted) and {r.pk: r.v for r in rows} == wanted

    check()


def test_small_updates_do_not_shuffle_the_base(spark, tmp_path):
    path = str(tmp_path / "base")
    spark.range(1000).select(F.col("id").alias("pk"), F.lit("x").alias("v")).write.parquet(path)
    spark.createDataFrame([(5, "y")], "pk long, v string").write.parquet(path + "-update")
    loads = [spark.read.parquet(path), spark.read.parquet(path + "-update")]
    plan = executed_plan(records.load_by_key(loads, ["pk"]))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hash" not in plan


def test_a_key_reloaded_over_and_over_folds_before_the_exchange(spark):
    df = spark.range(0, 20000, 1, 8).select(
        (F.col("id") < 0).cast("int").alias("pk"), F.col("id").alias("at"), F.col("id").cast("string").alias("v")
    )
    last = records.last_per_key(df, ["pk"], ["at"])
    assert last.first().v == "19999"
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert plan.index("row_number(), 1, Partial") > plan.index("Exchange hashpartitioning")


def test_records_without_a_key_stay_with_positions_too(spark):
    df = spark.createDataFrame(
        [("m", None, "a", 1), ("m", None, "a", 1), ("m", None, "b", 2), ("m", 1, "c", 3), ("m", 1, "d", 4), (None, 1, "e", 5)],
        "model string, pk long, v string, at int",
    )
    for loads in ([df], [df.limit(0), df], [df.where("pk is null"), df.where("pk is not null or model is null")]):
        out = records.load_by_key(loads, ["model", "pk"], ["at"])
        assert sorted(r.v for r in out.collect()) == ["a", "a", "b", "d", "e"]


def test_equal_positions_give_one_and_the_same_row(spark):
    rows = [(1, f"v{i}", 0) for i in range(50)]
    found = {
        records.last_per_key(spark.createDataFrame(made, "pk long, v string, at int").repartition(n), ["pk"], ["at"]).first().v
        for made in (rows, rows[::-1])
        for n in (1, 5)
    }
    assert len(found) == 1


# -- references ------------------------------------------------------------------------

PROFILES = [(1000, "admin"), (1001, "other")]


def test_integer_reference(spark):
    keys = spark.createDataFrame([(1, 1000, "k1"), (2, 7, "k2"), (3, None, "k3")], "pk long, user long, key string")
    profiles = spark.createDataFrame(PROFILES, "pk long, username string")
    inner = records.resolve_reference(keys, profiles, F.col("user"), "pk", {"username": "username"})
    assert pairs(inner) == [(1, 1000, "k1", "admin")]
    outer = records.resolve_reference(keys, profiles, F.col("user"), "pk", {"username": "username"}, optional=True)
    assert {r.pk: r.username for r in outer.collect()} == {1: "admin", 2: None, 3: None}


def test_natural_reference(spark):
    apps = spark.createDataFrame([(1, ["admin"]), (2, ["nobody"]), (3, []), (4, None)], "pk long, user array<string>")
    profiles = spark.createDataFrame(PROFILES, "pk long, username string")
    first = F.try_element_at("user", F.lit(1))
    out = records.resolve_reference(apps, profiles, first, "username", {"owner": "pk"}, optional=True)
    assert {r.pk: r.owner for r in out.collect()} == {1: 1000, 2: None, 3: None, 4: None}


def test_two_nullable_references_on_one_table(spark):
    tasks = spark.createDataFrame([(1, None, 1), (2, 1, None)], "pk long, interval long, crontab long")
    intervals = spark.createDataFrame([(1, 60)], "pk long, every long")
    crontabs = spark.createDataFrame([(1, "4")], "pk long, hour string")
    out = records.resolve_reference(tasks, intervals, F.col("interval"), "pk", {"every": "every"}, optional=True)
    out = records.resolve_reference(out, crontabs, F.col("crontab"), "pk", {"hour": "hour"}, optional=True)
    assert pairs(out.select("pk", "every", "hour")) == [(1, None, "4"), (2, 60, None)]


def test_dangling_reference_is_never_null(spark):
    rows = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "pk long, host long")
    hosts = spark.createDataFrame([(1,), (None,)], "pk long")
    assert pairs(records.dangling_references(rows, hosts, F.col("host"), "pk")) == [(2, 9)]


@pytest.fixture
def no_broadcast(spark):
    """Shuffle joins only, with thresholds small enough for test data to count as skewed."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "30KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def hot(spark, tmp_path, reference):
    path = str(tmp_path / "hot")
    spark.range(0, 60000, 1, 8).select(
        F.col("id").alias("pk"), reference.alias("ref"), F.md5(F.col("id").cast("string")).alias("pad")
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_null_references_stay_out_of_the_shuffle(spark, tmp_path, no_broadcast):
    rows = hot(spark, tmp_path, F.when(F.col("id") % 3 == 0, F.col("id") % 50))
    target = spark.range(50).select(F.col("id").alias("pk"), (F.col("id") * 2).alias("twice"))
    out = records.resolve_reference(rows, target, F.col("ref"), "pk", {"twice": "twice"}, optional=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    joined, beside = plan.split("SortMergeJoin")[1].rsplit("FileScan", 1)
    assert "IsNotNull(ref)" in joined and "IsNull(ref)" in beside and "Exchange" in joined
    nulls = out.where("ref is null").groupBy(F.spark_partition_id()).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in nulls.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 40000 and len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    assert out.where("twice = 2 * ref").count() == 20000 and out.count() == 60000


@pytest.mark.parametrize("optional", [True, False])
def test_a_hot_reference_is_split(spark, tmp_path, no_broadcast, optional):
    rows = hot(spark, tmp_path, F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")))
    target = spark.range(60000).select(F.col("id").alias("pk"), (F.col("id") * 2).alias("twice"))
    out = records.resolve_reference(rows, target, F.col("ref"), "pk", {"twice": "twice"}, optional=optional)
    assert "SortMergeJoin(skew=true)" in executed_plan(out)
    assert out.where("twice = 2 * ref").count() == 60000


def test_a_hot_dangling_reference_is_split(spark, tmp_path, no_broadcast):
    rows = hot(spark, tmp_path, F.when(F.col("id") % 3 == 0, -7).otherwise(F.col("id")))
    target = spark.range(60000).select(F.col("id").alias("pk"))
    out = records.dangling_references(rows, target, F.col("ref"), "pk")
    assert "SortMergeJoin(skew=true)" in executed_plan(out)
    assert out.count() == 20000


def test_times_order_loads(spark):
    base = datetime(2024, 1, 1)
    rows = [(1, base + timedelta(seconds=i), i) for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, "pk int, at timestamp_ntz, v int")
    assert records.last_per_key(df, ["pk"], ["at"]).first().v == 3
    only_keys = df.select("pk")
    assert records.last_per_key(only_keys, ["pk"], []).count() == 1
