import io
import zipfile
from datetime import datetime

from helpers import evaluate
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


from shelfmark.operators import counts, ingest

OLD, MID, NEW = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)


def test_plan_rules(spark):
    source = spark.createDataFrame(
        [
            ("missing", MID, False, None),
            ("corrupt", OLD, False, None),
            ("older", OLD, False, None),
            ("equal", MID, False, None),
            ("newer", NEW, False, None),
            ("untimed", None, False, None),
            ("file older", OLD, True, True),
            ("file gone", NEW, True, False),
            ("file first", NEW, True, True),
        ],
        "item string, source_time timestamp_ntz, is_file boolean, exists boolean",
    )
    names = ["corrupt", "older", "equal", "newer", "untimed", "file older", "file gone", "extra"]
    local = spark.createDataFrame(
        [(n, MID, n == "corrupt") for n in names], "item string, local_time timestamp_ntz, corrupt boolean"
    )
    plan = {r.item: (r.action, r.reason) for r in ingest.ingest_plan(source, local).collect()}
    assert plan == {
        "missing": ("fetch", "missing"),
        "corrupt": ("fetch", "corrupt"),
        "older": ("skip", "older"),
        "equal": ("fetch", "updated"),
        "newer": ("fetch", "updated"),
        "untimed": ("fetch", "updated"),
        "file older": ("copy", "file source"),
        "file gone": ("absent", "file source"),
        "file first": ("copy", "missing"),
    }
    short = ingest.ingest_plan(source.select("item", "source_time"), local)
    assert {r.item: r.action for r in short.collect()}["file older"] == "skip"


def by_hand(name, source_time, is_file, exists, local):
    if is_file:
        return "copy" if exists else "absent"
    if name not in local or local[name][1]:
        return "fetch"
    return "skip" if source_time is not None and source_time < local[name][0] else "fetch"


def test_made_up_plans(spark):
    times = st.sampled_from([OLD, MID, NEW])
    items = st.lists(
        st.tuples(st.sampled_from("abcdef"), st.none() | times, st.booleans(), st.booleans()), max_size=10
    )
    copies = st.dictionaries(st.sampled_from("abcdef"), st.tuples(times, st.booleans()), max_size=6)

    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(items, copies)
    def check(made, local):
        source = spark.createDataFrame(
            made, "item string, source_time timestamp_ntz, is_file boolean, exists boolean"
        )
        there = spark.createDataFrame(
            [(k, *v) for k, v in local.items()], "item string, local_time timestamp_ntz, corrupt boolean"
        )
        got = sorted((r.item, r.action) for r in ingest.ingest_plan(source, there).collect())
        assert got == sorted((m[0], by_hand(*m, local)) for m in made)

    check()


def test_sizes(spark):
    rows = [(1, 5, 5), (2, 5, 4), (3, 0, 9), (4, None, 9), (5, 5, None)]
    df = spark.createDataFrame(rows, "id int, expected long, written long")
    assert sorted(r.id for r in ingest.accepted_by_size(df, "expected", "written").collect()) == [1, 3, 4]


def test_counts_with_an_absent_kind(spark):
    df = spark.createDataFrame([("layers",), ("layers",), ("other",), (None,)], "kind string")
    kinds = ["layers", "maps"]
    assert {r.kind: r.n for r in counts.resource_counts(df, kinds).collect()} == {"layers": 2, "maps": 0}
    assert counts.counts_wide(df, kinds).first().asDict() == {"layers": 2, "maps": 0}
    empty = counts.resource_counts(df.limit(0), kinds)
    assert {r.kind: r.n for r in empty.collect()} == {"layers": 0, "maps": 0}


def test_windows(spark):
    rows = [
        (datetime(2024, 1, 1, 0, 0, 59, 999999), "s", 1.0),
        (datetime(2024, 1, 1, 0, 0, 0), "s", 3.0),
        (datetime(2024, 1, 1, 0, 1, 0), "s", None),
        (None, "s", 5.0),
    ]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, service string, value double")
    got = sorted(tuple(r) for r in counts.metric_windows(df).collect())
    assert got == [
        (datetime(2024, 1, 1, 0, 0), "s", 2, 4.0, 1.0, 3.0),
        (datetime(2024, 1, 1, 0, 1), "s", 1, None, None, None),
    ]
    plan = counts.metric_windows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.index("partial_sum") > plan.index("Exchange hashpartitioning")


def test_zip_check_agrees_with_the_standard_library(spark):
    def archive(comment=b"", size=10):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.txt", b"x" * size)
            z.comment = comment
        return out.getvalue()

    whole = archive()
    contents = [
        whole, archive(b"c" * 65535), archive(size=200_000), archive(b"note"), whole[:-1], whole[:-20],
        whole[: len(whole) // 2], b"", b"PK", b"plain text", b"PK\x05\x06", whole + b"x" * 70_000,
    ]
    wanted = [zipfile.is_zipfile(io.BytesIO(c)) for c in contents]
    got = evaluate(spark, [bytearray(c) for c in contents] + [None], ingest.is_zip, "binary")
    assert got == wanted + [False]
