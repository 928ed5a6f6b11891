from datetime import datetime
from fnmatch import fnmatchcase

import pytest
from helpers import column, evaluate
from pyspark.sql import functions as F

from shelfmark.operators import selection

NAMES = ["lowland_a", "lowland", "lowlandXa", "heath", "Heath", "he[a]th", "a.b", "axb", "new\nline", "x^y", ""]


@pytest.mark.parametrize(
    "glob",
    ["lowland_*", "heath", "*a", "*owl*", "*", "**", "l*d", "?eath", "[hH]eath", "[!h]eath", "he[[]a]th",
     "a.b", "new*", "x[^]y", "[a-c]?b", "l*[da]", "", "[", "x[]y", "*line"],
)
def test_globs_agree_with_the_standard_library(spark, glob):
    got = evaluate(spark, NAMES, lambda c: selection.matches_names(c, [glob]))
    assert got == [fnmatchcase(n, glob) for n in NAMES]


def test_simple_globs_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    column(spark, NAMES).write.parquet(path)
    test = selection.included(F.col("v"), ["lowland_*", "heath", "*th"])
    plan = spark.read.parquet(path).where(test)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1]
    assert "StringStartsWith(v,lowland_)" in pushed and "StringEndsWith(v,th)" in pushed
    assert "RLIKE" not in plan.upper()


def test_exclude_wins_and_null_is_not_excluded(spark):
    schema = "name string, kind string, data_time timestamp_ntz, path string"
    at = datetime(2024, 1, 5)
    rows = [
        ("lowland_a", "vector", at, "/data/x"),
        ("lowland_b", "vector", at, "/database/x"),
        ("lowland_b", "raster", at, "/y"),
        (None, "vector", at, "/y"),
        ("lowland_c", "vector", None, "/y"),
        ("lowland_d", "vector", at, None),
    ]
    df = spark.createDataFrame(rows, schema)

    def names(**options):
        return sorted(str(r.name) for r in selection.select_layers(df, **options).collect())

    assert names(include="lowland_*", exclude="*_a") == ["lowland_b", "lowland_b", "lowland_c", "lowland_d"]
    assert names(exclude="*_?", raster=False) == ["None"]
    assert names(exclude_paths="/data", raster=False) == ["None", "lowland_b", "lowland_c", "lowland_d"]
    assert names(data_time=">= 2024-01-05", raster=False) == ["None", "lowland_a", "lowland_b", "lowland_d"]
    assert names(data_time="> 2024-01-05T00:00") == []
    assert names(vector=False, raster=False) == []


@pytest.mark.parametrize("sign, kept", [("<", 1), ("<=", 2), ("=", 1), (">=", 2), (">", 1)])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_time_signs_on_both_time_types(spark, sign, kept, kind):
    texts = column(spark, ["2024-01-01 00:00:00", "2024-01-02 12:00:00", "2024-01-03 00:00:00"])
    df = texts.select(F.col("v").cast(kind).alias("t"))
    test = selection.data_time_matches(df, "t", f"{sign} 2024-01-02T14:00+02:00")
    assert df.where(test).count() == kept


@pytest.mark.parametrize(
    "spec", ["> 20019-04-05T24:00", "2024-01-01", "!= 2024-01-01", "> 2024-13-01", "> yesterday", "", ">"]
)
def test_bad_time_filters_are_refused(spec):
    with pytest.raises(ValueError):
        selection.parse_time_filter(spec)


def test_time_filter_refuses_other_columns(spark):
    with pytest.raises(TypeError):
        selection.data_time_matches(column(spark, ["x"]), "v", "> 2024-01-01")


def test_paths(spark):
    paths = ["/data", "/data/x", "/database", "/x/data", None]
    got = evaluate(spark, paths, lambda c: selection.outside_paths(c, ["/data/"]))
    assert got == [False, False, True, True, True]
    assert evaluate(spark, paths, lambda c: selection.outside_paths(c, [])) == [True] * 5


def test_apps_and_browse(spark):
    models = ["people.Profile", "sites.site", "people", "peoples.x"]
    assert evaluate(spark, models, lambda c: selection.in_apps(c, selection.comma_list(" people , ,layers"))) == [
        True, False, True, False,
    ]
    df = column(spark, ["layers", "maps", "layers"])
    assert selection.browse(df, "layers", "v").count() == 2


def test_switches_leave_kinds_they_do_not_name(spark):
    df = spark.createDataFrame([(k,) for k in ("vector", "raster", "time", None)], "kind string").withColumn("name", F.lit("n"))
    assert selection.select_layers(df).count() == 4
    assert {r.kind for r in selection.select_layers(df, raster=False).collect()} == {"vector", "time", None}


def test_data_time_of_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",)], "d string").select(F.col("d").cast("date"))
    for spec, n in (("> 2024-01-02", 1), (">= 2024-01-02", 2), ("> 2024-01-01T12:00", 2), ("= 2024-01-02", 1)):
        assert df.where(selection.data_time_matches(df, "d", spec)).count() == n
