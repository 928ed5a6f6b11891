"""Checks that services have missed, from a stream of their checks.

A service is checked once per interval. After its last check another is due one interval later,
then every interval until the next check comes or the check's life ends. Whether one was missed
is known once the watermark has passed the time it was due: what would have come in time can
only come too late.

State of a service are the stretches of its checks that are no further apart than the interval,
in any order of arrival, and the last due time reported. Stretches that the watermark has passed
fold into the last of them, so a busy service holds one or two, however many checks it has. One
timer at a time stands at the next due time; once a check's life has ended, it clears the state.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelfmark.functions.values import duration_seconds, utc_instant
from shelfmark.session import ROCKSDB

LIFE_DAYS = 7
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUTPUT = "service string, seconds bigint, last_micros bigint, missed bigint, due_micros bigint"
MICROS = 1_000_000


def with_check(stretches: list[tuple[int, int]], at: int, interval: int) -> None:
    """Add a check to sorted stretches, joining those it brings together."""
    k = bisect_left(stretches, (at, at))
    first, last = at, at
    if k < len(stretches) and stretches[k][0] - at <= interval:
        last = max(at, stretches[k][1])
        del stretches[k]
    if k and at - stretches[k - 1][1] <= interval:
        first, last = stretches[k - 1][0], max(last, stretches[k - 1][1])
        del stretches[k - 1]
        k -= 1
    stretches.insert(k, (first, last))


def missed_until(
    stretches: list[tuple[int, int]], interval: int, life: int, reported: int, watermark: int
) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], int | None]:
    """(last check, number, due) of what was missed up to the watermark and not reported before,
    the stretches still needed, and when to look again."""
    missed, again = [], None
    for k, (_, end) in enumerate(stretches):
        following = stretches[k + 1][0] if k + 1 < len(stretches) else None
        number = max(1, (reported - end) // interval + 1)
        while True:
            due = end + number * interval
            if due - end > life or (following is not None and due >= following):
                break
            if due > watermark:
                again = due if again is None else min(again, due)
                break
            missed.append((end, number, due))
            number += 1
    passed = [s for s in stretches if s[0] <= watermark]
    needed = passed[-1:] + stretches[len(passed) :]
    if again is None and stretches:
        again = stretches[-1][1] + life + 1
        if again <= watermark:
            needed, again = [], None
    return missed, needed, again


class MissedChecks(StatefulProcessor):
    """Keyed by service and interval (seconds); rows bring the time of a check in microseconds."""

    def __init__(self, life_days: int):
        self.life = life_days * 86_400 * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stretches = handle.getListState("stretches", "first bigint, last bigint")
        self.reported = handle.getValueState("reported", "due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stretches = [tuple(s) for s in self.stretches.get()]
        interval = key[1] * MICROS
        for row in rows:
            with_check(stretches, row["at"], interval)
        yield from self._advance(key, stretches, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [tuple(s) for s in self.stretches.get()], timerValues)

    def _advance(self, key, stretches: list[tuple[int, int]], timerValues) -> Iterator[Row]:
        service, seconds = key
        reported = self.reported.get()[0] if self.reported.exists() else -1
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        missed, needed, again = missed_until(stretches, seconds * MICROS, self.life, reported, watermark)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if again is not None:
            self.handle.registerTimer(-(-again // 1000))
        if needed:
            self.stretches.put(needed)
        else:
            self.stretches.clear()
            self.reported.clear()
        if missed and needed:
            self.reported.update((max(due for _, _, due in missed),))
        for last, number, due in missed:
            yield Row(service=service, seconds=seconds, last_micros=last, missed=number, due_micros=due)

    def close(self) -> None:
        pass


def missed_checks(
    checks: DataFrame,
    *,
    lateness: str = "10 minutes",
    life_days: int = LIFE_DAYS,
    service: str = "service",
    time: str = "last_check",
    interval: str = "check_interval",
) -> DataFrame:
    """service, check_interval (seconds), last_check, missed (1, 2, ...) and due of every missed check.

    ``interval`` is a duration text; rows without service, time or a positive interval say
    nothing. A service checked at two intervals is two. Rows come once the watermark, ``lateness``
    behind the newest check, has passed their due time.
    """
    timed = checks.select(
        F.col(service).cast("string").alias("service"),
        utc_instant(checks, time).alias("time"),
        duration_seconds(F.col(interval)).cast("bigint").alias("seconds"),
    )
    timed = timed.withWatermark("time", lateness).where("service IS NOT NULL AND time IS NOT NULL AND seconds > 0")
    found = (
        timed.select("service", "seconds", "time", F.unix_micros("time").alias("at"))
        .groupBy("service", "seconds")
        .transformWithState(MissedChecks(life_days), OUTPUT, "Append", "EventTime")
    )
    return found.select(
        "service",
        F.col("seconds").alias("check_interval"),
        F.timestamp_micros("last_micros").alias("last_check"),
        "missed",
        F.timestamp_micros("due_micros").alias("due"),
    )


def run_overdue_stream(
    checks: DataFrame, target: str, checkpoint: str, **how: str | int
) -> StreamingQuery:
    """Work off all checks not seen before, then stop. Append output as Parquet, restartable.

    Timers need a state store that keeps more than one column family; the query is started with
    RocksDB, whatever the session's own choice is.
    """
    spark: SparkSession = checks.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            missed_checks(checks, **how)
            .writeStream.outputMode("append")
            .format("parquet")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(PROVIDER, before)
