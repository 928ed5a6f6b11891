"""Tables of patterns and folders against the expressions for a few of them."""

import random
import re

import pytest
from helpers import executed_plan
from pyspark.sql import functions as F

from shelfmark.operators import pattern_tables, selection
from shelfmark.plans import catalogue_queries

NAMES = ["a", "ab", "abc", "abcd", "xabcx", "a/b", "a*b", "[x]", "[x", "é中😀", "", "A.b", "a\nb", "zzz", "ab" * 40, "a\\b", "]", "a-c", "^a"]
GLOBS = ["*", "?", "??*", "a*", "*b", "*bc*", "a?c*", "[ab]*", "[!a]*", "a[!x]b", "[[]x]", "[x", "*[]]", "*中?", "a\\*", "*.b", "[a-c]", "", "zz?", "ab*ab*", "a[*]b", "[^]a"]


def kept(spark, names, patterns, how):
    rows = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "i int, `n.m` string, pattern string")
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    found = how(rows, "n.m", table)
    assert found.columns == rows.columns
    return sorted(r.i for r in found.collect())


def test_like_the_expressions(spark):
    rnd = random.Random(4)
    cases = [[g] for g in ("*", "[!a]*", "[x", "a?c*")] + [GLOBS, [], [None, "a*", "a*"]]
    made = ["".join(rnd.choices(["a", "b", "c", "*", "?", "[ab]", "[!c]", "x"], k=rnd.randint(1, 6))) for _ in range(60)]
    names = [*NAMES, None, "a", *("".join(rnd.choices("abcx", k=rnd.randint(0, 7))) for _ in range(200))]
    for patterns in [*cases, made]:
        known = [p for p in patterns if p is not None]
        tests = [re.compile(r"(?s)\A(?:" + selection._glob_regex(p) + r")\Z") for p in known]
        matched = [i for i, n in enumerate(names) if n is not None and any(t.match(n) for t in tests)]
        assert kept(spark, names, patterns, pattern_tables.included_by) == matched, patterns
        if patterns is made:
            assert kept(spark, names, patterns, pattern_tables.not_excluded_by) == sorted(set(range(len(names))) - set(matched))


def test_many_patterns_of_one_run_are_joined_by_it(spark):
    """A hundred thousand patterns, no cross join, and a run that most names hold."""
    names = spark.range(3000).select(F.concat(F.lit("common/"), "id").alias("name"))
    patterns = spark.range(100_000).select(F.concat(F.lit("*"), F.col("id") * 7, F.lit("?")).alias("pattern"))
    found = pattern_tables.matched_names(names, patterns)
    wanted = {f"common/{n}" for n in range(3000) if any(int(t) % 7 == 0 for t in [str(n)[k:-1] for k in range(len(str(n)) - 1)] if t == str(int(t)))}
    plan = executed_plan(found)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert {r.name for r in found.collect()} == wanted


def test_patterns_meet_few_names_where_short_runs_are_shared(spark):
    """Every three digits occur in names, the numbers of most patterns in none, and one text in all."""
    names = spark.range(4000).select(F.concat(F.lit("http://a.example.org/"), F.lpad("id", 4, "0")).alias("name"))
    number = F.when(F.col("id") % 10 == 0, F.col("id") / 10).otherwise(F.col("id") * 1009 + 10_000).cast("bigint")
    patterns = spark.range(40_000).select(F.concat(F.lit("*.example.???/*"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), "0"), F.lit("*")).alias("pattern"))
    named = pattern_tables._named(names)
    anchors, bare = pattern_tables._anchored(named, patterns)
    met = pattern_tables._meetings(named, anchors)
    assert met.count() <= 16_000 and bare.isEmpty()
    assert pattern_tables.matched_names(names, patterns).count() == 4000


def test_patterns_of_the_query_with_keys_that_no_name_holds(spark, tmp_path):
    """Keys of seven digits, names of four: what the query joins is gone before names meet it."""
    sf = "/root/testdata/sf0.001"
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("events", "event_id")):
        spark.read.parquet(f"{sf}/{name}.parquet").withColumn(key, F.col(key) + 1_000_000).write.parquet(str(tmp_path / f"{name}.parquet"))
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    whole = pages.where("page_id % 50 = 0").select("url")
    names = pattern_tables._named(pages.select(F.col("url").alias("name")))
    anchors, _ = pattern_tables._anchored(names, catalogue_queries._patterns(spark, str(tmp_path)))
    assert anchors.count() == whole.distinct().count()
    found = catalogue_queries.name_select_table(spark, str(tmp_path))
    assert sorted(r.page_id for r in found.collect()) == sorted(r.page_id for r in pages.join(whole, "url", "left_semi").collect())


def test_more_common_runs_than_the_driver_gets(spark, monkeypatch):
    """Which run a pattern asks for first changes no row."""
    for common, step in ((0, 4), (1, 1), (10**6, 9)):
        monkeypatch.setattr(pattern_tables, "COMMONEST", common)
        monkeypatch.setattr(pattern_tables, "STEP", step)
        patterns = ["ab*c*", "*longer than eight*", "exactly this one, without wildcards", "*[0-9]", "??", ""]
        names = ["abxc", "abc", "a longer than eight or nine", "longer than eigh", "exactly this one, without wildcards", "exactly this one", "7", "77", "", "x"]
        assert kept(spark, names, patterns, pattern_tables.included_by) == [0, 1, 2, 4, 6, 7, 8]


def test_a_name_that_equals_a_pattern_with_wildcards(spark):
    assert kept(spark, ["[x]", "x", "a[bc]d", "y"], ["[x]", "a[bc]d"], pattern_tables.included_by) == [0, 1, 2]
    assert kept(spark, ["[x]", "x", "a[bc]d", "y"], ["[x]", "a[bc]d"], pattern_tables.not_excluded_by) == [3]


@pytest.mark.parametrize("folders", [["/a"], ["/a/", "/b/c", "/a/x", None], ["/"], [], ["a", "/é"]])
def test_folders_like_the_expression(spark, folders):
    paths = ["/a", "/a/b", "/ab", "/a!", "/b/c", "/b/c/d/e", "/b", "/", "", "a", "a/b", None, "/é/x", "/a", "/b/c.d"]
    rows = spark.createDataFrame([(i, p, "x") for i, p in enumerate(paths)], "i int, `p.q` string, key string")
    table = spark.createDataFrame([(f,) for f in folders], "folder string")
    found = pattern_tables.outside_folders(rows, "p.q", table)
    assert found.columns == rows.columns
    wanted = rows.where(selection.outside_paths(F.col("`p.q`"), [f for f in folders if f is not None]))
    assert sorted(r.i for r in found.collect()) == sorted(r.i for r in wanted.collect())
