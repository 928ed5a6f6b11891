from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shelfmark.operators.counts import metric_windows
from shelfmark.streaming import monitoring

EVENTS = "/root/testdata/sf0.001/events.parquet"


def rows_of(df):
    columns = [F.col("window_start").cast("timestamp_ntz"), "service", "n", F.round("total", 6), "least", "greatest"]
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_closed_windows_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumnRenamed("event_type", "service")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    events.orderBy("ts").coalesce(1).write.parquet(source)

    def run():
        query = monitoring.run_metric_stream(
            spark, source, events.schema, target, str(tmp_path / "cp"), lateness="1 hour"
        )
        assert query.awaitTermination(120)
        return spark.read.parquet(target)

    last = events.agg(F.max("ts")).first()[0]
    closed = F.col("window_start") + F.expr("interval 1 minute") <= F.lit(str(last - timedelta(hours=1))).cast("timestamp_ntz")
    batch = metric_windows(events)
    assert rows_of(run()) == rows_of(batch.where(closed))

    # Later files close the rest; what was written before is not written again.
    late = (last + timedelta(days=1)).replace(microsecond=0)
    spark.createDataFrame(
        [(-1, late, 0, "s", 1.0, "{}"), (-2, datetime(2000, 1, 1), 0, "s", 1.0, "{}")], events.schema
    ).coalesce(1).write.mode("append").parquet(source)
    assert rows_of(run()) == rows_of(batch)


def test_a_restart_with_nothing_new_adds_nothing(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumnRenamed("event_type", "service").limit(50)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    events.write.parquet(source)
    counts = []
    for _ in range(2):
        query = monitoring.run_metric_stream(
            spark, source, events.schema, target, str(tmp_path / "cp"), lateness="0 seconds"
        )
        assert query.awaitTermination(120)
        counts.append(spark.read.parquet(target).count())
    assert counts[0] == counts[1] > 0
