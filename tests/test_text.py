import re

from helpers import column, evaluate
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from shelfmark.functions import text


def by_hand(content, values):
    """Search, cut and join, one tag after the other; any miss leaves the content as it was."""
    draft = content
    for tag, new in values.items():
        found = re.search(f"{tag}>([^<]+)", draft) if draft is not None else None
        if not found:
            return content
        draft = draft[: found.start(1)] + new + draft[found.end(1) :]
    return draft


def rewritten(spark, contents, values):
    df = text.rewrite_elements(column(spark, contents), "v", values)
    return [r.v for r in sorted(df.collect(), key=lambda r: r.i)]


def test_elements_first_hit_all_or_nothing_and_literal_values(spark):
    contents = [
        "<a>1</a>\n<a>2</a><b>x</b>",
        "<a>1</a>",
        "<a></a>tail<b>x</b>",
        "<b>x</b><a>line\nbreak</a>",
        "<a></a><b>x</b>",
        "",
        None,
    ]
    values = {"a": "cost $1 \\ $", "b": "http://h/"}
    got = rewritten(spark, contents, values)
    assert got == [by_hand(c, values) for c in contents]
    assert got[0] == "<a>cost $1 \\ $</a>\n<a>2</a><b>http://h/</b>"
    assert got[1] == "<a>1</a>"


def test_elements_see_what_earlier_steps_wrote(spark):
    values = {"a": "new b>text", "b": "B"}
    contents = ["<a>1</a>", "<a>b>old</a>", "<b>2</b><a>1</a>"]
    assert rewritten(spark, contents, values) == [by_hand(c, values) for c in contents]


def test_elements_on_made_up_documents(spark):
    pieces = st.sampled_from(["<a>", "</a>", "<b>", "</b>", "x", "\n", "a>", "<", ">", "é$"])
    documents = st.lists(pieces, max_size=12).map("".join)

    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(documents, min_size=50, max_size=50))
    def check(contents):
        values = {"a": "A$0", "b": "B<c>"}
        assert rewritten(spark, contents, values) == [by_hand(c, values) for c in contents]

    check()


def test_element_steps_do_not_multiply(spark):
    values = {f"t{i}": "x" for i in range(12)}
    plan = text.rewrite_elements(column(spark, ["q"]), "v", values)
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_rules_in_order_and_case(spark):
    rules = [text.Rule("Old", "a$1.b"), text.Rule("story", "TALE", any_case=True)]
    got = evaluate(spark, ["Old old Story STORY", "O.d", None], lambda c: text.apply_rules(c, rules))
    assert got == ["a$1.b old TALE TALE", "O.d", None]
    chained = [text.Rule("a", "b"), text.Rule("b", "c")]
    assert evaluate(spark, ["ab"], lambda c: text.apply_rules(c, chained)) == ["cc"]


def test_relabel_items_exactly(spark):
    menu = [[("Stories", 1), ("stories", 2), ("STORIES", 3), (None, 4)], [], None]
    got = evaluate(
        spark,
        menu,
        lambda c: text.relabel_items(c, {"Stories": "Tales", "stories": "Tales"}),
        "array<struct<label:string,n:int>>",
    )
    assert [r.label for r in got[0]] == ["Tales", "Tales", "STORIES", None]
    assert [r.n for r in got[0]] == [1, 2, 3, 4]
    assert got[1:] == [[], None]


def test_boolean_text(spark):
    values = ["yes", "TRUE", "T", "1", "no", "on", " yes", "", None]
    assert evaluate(spark, values, text.text_to_bool) == [True] * 4 + [False] * 5


def test_lines(spark):
    rows = text.split_lines(column(spark, ["a\nb", "", None, "c\n"]), "v", keep=["i"]).collect()
    assert sorted((r.i, r.line) for r in rows) == [(0, "a"), (0, "b"), (1, ""), (3, ""), (3, "c")]


def test_json_text(spark):
    assert evaluate(spark, ["[]", '["a", 1]', None], text.json_items) == [[], ["a", "1"], None]
    assert evaluate(spark, ["{}", '{"k": 5}', None], text.json_entries) == [{}, {"k": "5"}, None]
    assert evaluate(spark, ['{"a.b": "x"}', "{}"], lambda c: text.json_member(c, "a.b")) == ["x", None]


def test_rules_fold_letters_beyond_ascii(spark):
    rules = [text.Rule("é", "e", any_case=True)]
    assert evaluate(spark, ["É é E"], lambda c: text.apply_rules(c, rules)) == ["e e E"]


def test_element_rules_of_their_own_for_each_document(spark):
    df = spark.createDataFrame(
        [("a", "<t>1</t><u>2</u>"), ("b", "<t>1</t><u>2</u>"), ("c", "<t>1</t>"), (None, "<t>1</t>"), ("a", None), ("b", "<t>1</t>")],
        "name string, html string",
    )
    out = text.rewrite_documents(df, "html", F.col("name"), {"a": {"t": "x"}, "b": {"t": "y", "u": "z"}})
    assert out.columns == df.columns
    assert [(r.name, r.html) for r in out.collect()] == [
        ("a", "<t>x</t><u>2</u>"), ("b", "<t>y</t><u>z</u>"), ("c", "<t>1</t>"), (None, "<t>1</t>"), ("a", None), ("b", "<t>1</t>"),
    ]


def test_columns_named_like_work_columns_stay(spark):
    df = spark.createDataFrame([("<a>x</a>", "d", "o", "k")], "v string, draft string, Own string, kept string")
    out = text.rewrite_documents(df, "v", F.lit("n"), {"n": {"a": "y"}, "m": {"a": "z"}})
    assert out.columns == df.columns and tuple(out.first()) == ("<a>y</a>", "d", "o", "k")
