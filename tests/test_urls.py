from urllib.parse import urlparse

import pytest
from helpers import evaluate
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import urls

SAMPLES = [
    "http://Example.COM/a/b.zip",
    "https://user:pa@ss@Host_1.example:8443/x/y;v=1?q=/z#/t",
    "http://[2001:DB8::1]:8080/geo/",
    "//plain.example/no/scheme",
    "http://host.example",
    "http://host.example?q=1",
    "http://host.example:/p",
    "http://host.example:99999/p",
    "mailto:someone@example.com",
    "/only/a/path.html",
    "no scheme at all",
    "",
    None,
]


def stdlib(url, part):
    if url is None:
        return None
    parsed = urlparse(url)
    if part == "port":
        try:
            return parsed.port
        except ValueError:
            return None
    if part == "last":
        return parsed.path.rsplit("/", 1)[-1]
    return parsed.hostname


@pytest.mark.parametrize(
    "part, expression",
    [("host", urls.url_host), ("port", urls.url_port), ("last", urls.url_last_part)],
)
def test_parts_agree_with_the_standard_library(spark, part, expression):
    assert evaluate(spark, SAMPLES, expression) == [stdlib(u, part) for u in SAMPLES]


def test_parts_of_made_up_urls(spark):
    hosts = st.from_regex(r"\A[A-Za-z][A-Za-z0-9_.\-]{0,12}\Z")
    made = st.builds(
        "{}://{}{}{}{}".format,
        st.sampled_from(["http", "HTTPS", "ftp"]),
        st.sampled_from(["", "u@", "u:p@", "a@b@"]),
        hosts,
        st.sampled_from(["", ":80", ":65535", ":0"]),
        st.from_regex(r"\A(/[a-z.;?#=]{0,4}){0,3}\Z"),
    )

    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(made, min_size=40, max_size=80))
    def check(samples):
        for part, expression in (("host", urls.url_host), ("port", urls.url_port), ("last", urls.url_last_part)):
            assert evaluate(spark, samples, expression) == [stdlib(u, part) for u in samples]

    check()


def test_public_url(spark):
    def build(port):
        return urls.public_url(F.lit("h.example"), port)

    got = evaluate(spark, ["443", "80", "8080", "", None], build)
    plain = "http://h.example/"
    assert got == ["https://h.example/", plain, "http://h.example:8080/", plain, plain]


def test_trailing_slash(spark):
    assert evaluate(spark, ["http://h", "http://h/", None], urls.with_trailing_slash) == [
        "http://h/",
        "http://h/",
        None,
    ]


def test_relative_stem(spark):
    paths = ["/b/x.zip", "/b/sub/y.zip", "/b/xzip", "/b/a.zip.zip", "/bb/x.zip", "/c/b/x.zip", "/b/.zip", None]
    got = evaluate(spark, paths, lambda p: urls.relative_stem(p, "/b"))
    assert got == ["x", "sub/y", "xzip", "a.zip", None, None, "", None]


def test_rewrite_reaches_nested_text_and_counts_rows(spark):
    schema = (
        "id int, url string, `dotted.name` string, links array<string>, "
        "meta struct<home:string,n:int,deep:array<struct<u:string>>>, extra map<string,string>"
    )
    rows = [
        (1, "http://a.b/x", None, ["http://a.b", None], ("http://a.b/", 1, [("http://a.b",)]), {"http://a.b": "http://a.b"}),
        (2, "http://aXb/x", "q", [], (None, 2, []), {}),
        (3, None, None, None, None, None),
        (4, "q", None, None, ("q", 1, [("http://a.b",)]), None),
    ]
    df = spark.createDataFrame(rows, schema)
    out = {r.id: r for r in urls.rewrite_base_url(df, "http://a.b", "https://c$1", "changed").collect()}
    assert out[1].url == "https://c$1/x"
    assert out[1].links == ["https://c$1", None]
    assert out[1].meta.home == "https://c$1/" and out[1].meta.deep[0].u == "https://c$1"
    assert out[1].extra == {"https://c$1": "https://c$1"}
    assert out[2].url == "http://aXb/x" and out[2]["dotted.name"] == "q"
    assert out[3].meta is None and out[3].links is None
    assert {i: r.changed for i, r in out.items()} == {1: True, 2: False, 3: False, 4: True}
    plan = urls.rewrite_base_url(df, "http://a.b", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 1
    with pytest.raises(ValueError):
        urls.rewrite_base_url(df, "", "x")


def test_map_keys_are_rewritten_too(spark):
    df = spark.createDataFrame([({"http://o/a": "http://o/b"},), (None,)], "m map<string,string>")
    out = urls.rewrite_base_url(df, "http://o", "http://n", "changed")
    assert [(r.m, r.changed) for r in out.collect()] == [({"http://n/a": "http://n/b"}, True), (None, False)]
