"""Personal data: fixed formats, and candidates that boosted trees select.

High-recall generators propose overlapping spans: the four fixed formats, and looser ones
(runs of digits in groups, dotted numbers, anything around an @). Boosted trees score the
looser candidates by their form. They are fitted on two sets. One are the candidates of all
texts, labelled by evidence that does not ask whether a fixed format overlaps and
that the trees do not see: words before the candidate, a plus sign before it, checksums and
rules of validity. Candidates without evidence are not in it. The other are made-up examples:
number formats that are and that are not personal data, the same for every table, so that a
table with few candidates, or with one kind only, still says where to draw the line. A
threshold for each generator is calibrated on the candidates of one half of all hashes, which
the fit on the other half has not seen; both labels count the same there and in the fit,
however many rows the table gives to one of them. Selected spans that overlap no fixed format and have
no evidence against them are added. Everything is DataFrame and SQL functions; scores are CASE
expressions made from the trees, so a row is scored where it is read, without a shuffle.

Trees split features at fixed cuts, so candidates that no cut tells apart are one row with a
count: the fit reads as many rows as there are forms, and no sample has to choose the splits.

Rows: a null text is empty and has no spans. Repeated rows are scanned each on their own and
count once in the fit, as do equal candidates after equal text; other columns pass through whatever their
names (the result is one struct column), an empty table gives an empty one and the trees of the
made-up examples.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import Numbered, stored

#: All candidates of a table together weigh as much as so many, or as many as there are, the half
#: held out included. So made-up examples, of each form so many, keep their say in any table.
OWN_WEIGHT = 8_000
EXAMPLES = 24
#: Distinct texts that are searched where the caller of ``fitted`` asks for a sample.
SAMPLE_TEXTS = 20_000
#: Least share of right selections among the held-out candidates at or above a threshold, were
#: there as many of both labels, and the candidates of each label that smoothing adds.
PRECISION = 0.98
SMOOTHING = 1
TREES, DEPTH = 12, 3
CONTEXT_CHARS = 24

# The fixed formats. Each pattern finds what the plain one would find from left to right, but
# never tries again inside a stretch that has failed; counts that would be dropped anyway are
# part of the pattern.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "number": r"(?<![A-Za-z0-9])[0-9(](?:[ ().-]{0,2}[0-9]){6,30}+(?![A-Za-z0-9])",
    "dotted": r"(?<![A-Za-z0-9.])[0-9]{1,5}+(?:\.[0-9]{1,5}+){2,6}+(?![A-Za-z0-9])",
    "address": r"(?<![^\s<>()\[\],;:\"'])[^\s<>()\[\],;:\"'@]{1,64}+@[^\s<>()\[\],;:\"'@]{1,255}+",
}
KINDS = (*BASE, *LOOSE)
#: Texts without these have no candidate of the kind; the other kinds need a digit.
NEEDS = {"email": "@", "address": "@", "phone": "+"}
#: Sorts as spans are listed: by start, then by kind.
SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string, found: string>"
#: Spans of a text that are gathered at a time.
BLOCK = 128
#: Set around matches for a moment; where a text has them, the third stands for both. To every
#: pattern here they are the same: no space, letter, digit or sign that it names.
OPEN, CLOSE, OTHER = "\ufdd0", "\ufdd1", "\ufdd2"

#: Forms of numbers and addresses, # any digit and & any but zero (fixed values).
PERSONAL_FORMS = (
    "(###) ###-####", "1 (&##) ###-####", "&##-###-####", "&## ### ####", "0## ### ## ##", "0### #######", "00## ### #######",
    "0#### ######", "(0##) #### ####", "## ## ## ## ##", "&##-##-####", "0## / #######", "&##.###.####", "0#.##.##.##.##",
    "0##.###.###", "jörg@straße#.de", "ana@niño#.es", "élise.#@café.fr", "имя#@почта.рф", "名#@例え.jp", "zoé#@hôtel##.com",
)
OTHER_FORMS = (
    "&#######", "&########", "&#########", "20##-0&-1#", "20##-0&-1# 1#:##", "1&.0&.20##", "978-&-##-######-#", "19##-20##",
    "& ### ###", "&.###.###", "&&.###.###", "20##.0&.1#", "&.#.#", "&.##.#", "&&.#.##", "&.#.#.#.#", "#### #### ####",
    "##-##-##-##", "&# &# &# &#", "# # # # # # # #", "20####01-##", "&###-####-##", "&##/####-## ###", "&#.&#.&#", "###-##-#", "x#@y", "#@#", "key@@##", "a#@b@c",
    "user#@host", "@@##@@",
)
#: What stands before them.
LEADS = ("the ", "", "see: ", "it is, ", "of ", "so. ")

FORM = {
    "length": lambda s, c: F.length(s),
    "digits": lambda s, c: F.length(F.regexp_replace(s, "[^0-9]", "")),
    "groups": lambda s, c: F.size(F.split(s, "[^0-9]+")),
    "dots": lambda s, c: F.length(s) - F.length(F.replace(s, F.lit("."), F.lit(""))),
    "dashes": lambda s, c: F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit(""))),
    "brackets": lambda s, c: F.length(s) - F.length(F.translate(s, "()", "")),
    "letters": lambda s, c: F.length(F.regexp_replace(s, "[^A-Za-z]", "")),
    "high": lambda s, c: F.coalesce(F.regexp_extract(s, "^[^0-9]*([0-9]{1,4})", 1).try_cast("int"), F.lit(0)),
    "spaces": lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))),
    "first": lambda s, c: F.length(F.regexp_extract(s, "^[^0-9]*([0-9]*)", 1)),
    "last": lambda s, c: F.length(F.regexp_extract(s, "([0-9]*)[^0-9]*$", 1)),
}
#: What stands before a candidate, evidence masked.
CONTEXT = {
    "sign": lambda s, c: c.rlike("[=:#$/_]\\s?$"),
    "worded": lambda s, c: c.rlike("\\p{L}\\s$"),
    "comma": lambda s, c: c.rlike("[,;.]\\s$"),
    "line": lambda s, c: c.rlike("(^|\\n)$"),
}
#: Words before a candidate that say what it is.
SAYS = {
    "call": r"(?i)tel\b|tel[eé]|phone|\bcall|\bfax|mobil",
    "pay": r"(?i)card\b|\bvisa\b|credit|\bcarte\b|karte\b|tarjeta",
    "host": r"(?i)\bip\b|\bhost|server",
    "mail": r"(?i)mail|\bcontact|\bwrite",
    "other": r"(?i)version|section|\bpage|\bpart\b|\bnumber|\bno\b|licen[sc]e|chapter|\bid\b|\bisbn|\border\b",
}
FEATURES = (*FORM, *CONTEXT, *(f"is_{kind}" for kind in LOOSE))
#: Where trees may split a feature: up to a cut or above it. Others are 0 or 1.
CUTS: dict[str, tuple[int, ...]] = {
    "length": (*range(3, 21), 22, 24, 28, 32, 48, 64),
    "digits": (*range(17), 18, 19, 24),
    "groups": tuple(range(1, 13)),
    "dots": tuple(range(7)),
    "dashes": tuple(range(6)),
    "brackets": (0, 1, 2),
    "letters": (*range(9), 10, 12, 16, 24),
    "high": (0, 1, 2, 9, 12, 19, 24, 31, 49, 99, 127, 199, 255, 299, 399, 499, 599, 699, 799, 899, 977, 979, 999,
             1799, 1899, 1949, 1999, 2029, 2099, 2999, 4999),
    "spaces": tuple(range(8)),
    "first": tuple(range(9)),
    "last": tuple(range(9)),
}
STEPS = [(name, cut) for name in FEATURES for cut in CUTS.get(name, (0,))]


def _luhn(found: Column) -> Column:
    digits = F.reverse(F.regexp_replace(found, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(found: Column) -> Column:
    return F.length(F.regexp_replace(found, "[^0-9]", ""))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda found: F.lit(True),
    # At most 255: no more than three digits after leading zeros, and those not above it.
    "ip": lambda found: F.forall(
        F.split(found, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    ),
    "card": _luhn,
    "phone": lambda found: _digits(found).between(10, 15),
}


def _scan(
    items: Column, zero: Column, advance: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str
) -> Column:
    """What ``emit`` makes of each item and the state before it; ``advance`` gives the next state.

    Arrays are extended by copying, so they are made in blocks: the cost stays close to
    proportional for a text with any number of items.
    """

    def none(of: str) -> Column:
        return F.from_json(F.lit("[]"), f"array<{of}>")

    def block(seen: Column, start: Column) -> Column:
        made = F.aggregate(
            F.slice(seen["items"], start, F.lit(BLOCK)),
            F.struct(seen["state"].alias("state"), none(kind).alias("out")),
            lambda part, item: F.struct(
                advance(part["state"], item).alias("state"),
                F.concat(part["out"], F.array(emit(part["state"], item))).alias("out"),
            ),
        )
        joined = F.transform(
            F.array(made),
            lambda part: F.struct(
                part["state"].alias("state"),
                seen["items"].alias("items"),
                F.concat(seen["out"], F.array(part["out"])).alias("out"),
            ),
        )
        return F.get(joined, F.lit(0))

    first = F.struct(zero.alias("state"), items.alias("items"), none(f"array<{kind}>").alias("out"))
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK))
    return F.aggregate(starts, first, block, lambda seen: F.flatten(seen["out"]))


def _located(text: Column, kind: str, pattern: str) -> Column:
    """All matches from left to right with their places in code points.

    One run of the pattern sets marks around the matches; cut there, the text is what lies
    between the matches and the matches in turn, so places are running lengths.
    """
    clean = F.when(text.rlike(f"[{OPEN}{CLOSE}]"), F.translate(text, OPEN + CLOSE, OTHER * 2)).otherwise(text)
    marked = F.regexp_replace(clean, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))
    return F.get(F.transform(F.array(marked), lambda m: F.when(m.contains(OPEN), _cut(m, kind)).otherwise(_no_spans())), F.lit(0))


def _no_spans() -> Column:
    return F.from_json(F.lit("[]"), f"array<{SPAN}>")


def _cut(marked: Column, kind: str) -> Column:
    """Spans from a text with marks around its matches."""
    pairs = F.transform(
        F.array(F.split(marked, f"[{OPEN}{CLOSE}]", -1)),
        lambda parts: F.transform(
            F.sequence(F.lit(0), F.size(parts) - 2, F.lit(2)),
            lambda i: F.struct(F.length(F.get(parts, i)).cast("bigint").alias("gap"), F.get(parts, i + 1).alias("found")),
        ),
    )

    def span(at: Column, pair: Column) -> Column:
        start = at + pair["gap"]
        return F.struct(
            start.alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            (start + F.length(pair["found"])).alias("end"),
            F.lit(kind).alias("kind"),
            pair["found"].alias("found"),
        )

    return _scan(
        F.get(pairs, F.lit(0)),
        F.lit(0).cast("bigint"),
        lambda at, pair: at + pair["gap"] + F.length(pair["found"]),
        span,
        SPAN,
    )


def _with_hits(spans: Column) -> Column:
    """Sorted spans with ``hit``: whether a fixed format overlaps. One pass each way."""
    last = F.lit(1 << 60).cast("bigint")
    fixed = lambda span: span["rank"] < len(BASE)
    names = [part.split(":")[0].strip() for part in SPAN.removeprefix("struct<").removesuffix(">").split(",")]

    def plus(span: Column, name: str, value: Column) -> Column:
        return F.struct(*[span[n].alias(n) for n in names], value.alias(name))

    reached = _scan(
        spans,
        F.lit(0).cast("bigint"),
        lambda reach, span: F.when(fixed(span), F.greatest(reach, span["end"])).otherwise(reach),
        lambda reach, span: plus(span, "reach", reach),
        SPAN.replace(">", ", reach: bigint>"),
    )
    hit = _scan(
        F.reverse(reached),
        last,
        lambda following, span: F.when(fixed(span), span["start"]).otherwise(following),
        lambda following, span: plus(span, "hit", (span["reach"] > span["start"]) | (following < span["end"])),
        SPAN.replace(">", ", hit: boolean>"),
    )
    return F.reverse(hit)


def candidates(text: Column, loose: bool = True) -> Column:
    """struct<base, loose>: spans of the fixed formats, and loose ones with ``hit``."""

    def all_of(kinds: dict[str, str], text: Column, digits: Column) -> list[Column]:
        there = {k: text.contains(NEEDS[k]) if k in NEEDS else digits for k in kinds}
        return [F.when(there[k], _located(text, k, p)).otherwise(_no_spans()) for k, p in kinds.items()]

    def valid(kind: str, spans: Column) -> Column:
        return F.filter(spans, lambda span: VALID[kind](span["found"]))

    def found(t: Column) -> Column:
        base = [valid(k, spans) for k, spans in zip(BASE, all_of(BASE, t["text"], t["digits"]))]
        return F.array_sort(F.concat(*base, *(all_of(LOOSE, t["text"], t["digits"]) if loose else [])))

    def parted(spans: Column) -> Column:
        if not loose:
            return F.struct(spans.alias("base"))
        both = F.transform(F.array(F.when(F.size(spans) > 0, _with_hits(spans)).otherwise(_no_hits())), lambda all_spans: F.struct(
            F.transform(F.filter(all_spans, lambda s: s["rank"] < len(BASE)), lambda s: s.dropFields("hit")).alias("base"),
            F.filter(all_spans, lambda s: s["rank"] >= len(BASE)).alias("loose"),
        ))
        return F.get(both, F.lit(0))

    # One-element arrays bind what is used more than once.
    whole = F.coalesce(text, F.lit(""))
    bound = F.array(F.struct(whole.alias("text"), whole.rlike("[0-9]").alias("digits")))
    return F.get(F.transform(F.transform(bound, found), parted), F.lit(0))


def _no_hits() -> Column:
    return F.from_json(F.lit("[]"), "array<" + SPAN.replace(">", ", hit: boolean>") + ">")


def with_candidates(documents: DataFrame, into: str, text: str = "text", loose: bool = True) -> DataFrame:
    """The documents with a struct column ``into``: base spans, and loose ones with ``hit``."""
    return documents.withColumn(into, candidates(F.col(f"`{text}`"), loose))


def _before(span: Column, text: Column) -> Column:
    first = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)).cast("int")
    return F.substring(text, first + 1, span["start"].cast("int") - first)


def _evidence(span: Column | dict[str, Column], before: Column) -> Column:
    """1 or 0 where something besides its form says that a candidate is or is no personal data, else null."""
    found = span["found"]
    says = {name: before.rlike(pattern) for name, pattern in SAYS.items()}
    digits = _digits(found)
    number, dotted = span["kind"] == "number", span["kind"] == "dotted"
    named = (
        F.when(number, (says["call"] & digits.between(7, 15)) | (says["pay"] & (digits >= 13)) | (says["host"] & VALID["ip"](found)))
        .when(dotted, says["call"] | says["host"])
        .otherwise(says["mail"])
    )
    return (
        F.when(number & digits.between(14, 19), F.when(_luhn(found), 1.0).when(digits > 15, 0.0))  # too long for a phone number
        .when(number & before.endswith("+"), F.when(digits.between(10, 15), 1.0))
        .when(named & says["other"], F.lit(None).cast("double"))
        .when(named, 1.0)
        .when(says["other"], 0.0)
        .when(dotted, F.when((F.size(F.split(found, r"\.")) == 4) & VALID["ip"](found), 1.0))
        .when(~number, F.when(found.rlike(r"@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}$"), 1.0).when(~found.rlike(r"@.*\."), 0.0))
    )


def _features(span: Column | dict[str, Column], before: Column) -> dict[str, Column]:
    """Numbers that describe a candidate by its form and by what stands before it."""
    before = F.regexp_replace(before, r"\+$", "")
    made = {name: f(span["found"], before) for name, f in (FORM | CONTEXT).items()}
    made |= {f"is_{kind}": span["kind"] == kind for kind in LOOSE}
    return {name: made[name].cast("double") for name in FEATURES}


def _tree(lines: list[str], value: Callable[[str], Column]) -> Column:
    """A CASE expression from the printed form of one tree; takes its lines off the list."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.removeprefix("Predict:")))
    step, above = map(int, re.fullmatch(r"If \(feature (\d+) in \{([01])\.0\}\)", line).groups())
    name, cut = STEPS[step]
    first = _tree(lines, value)
    lines.pop(0)  # Else
    return F.when(value(name) > cut if above else value(name) <= cut, first).otherwise(_tree(lines, value))


class Selector:
    """Scores of boosted trees and a threshold for each generator; none selects nothing."""

    def __init__(self, printed: str = "", weights: list[float] | None = None, thresholds: dict[str, float] | None = None):
        parts = re.split(r"\n\s*Tree \d+ \(weight \S+\):\n", printed)[1:]
        self.trees = [part.rstrip().split("\n") for part in parts]
        self.weights = weights or []
        self.thresholds = thresholds or {}

    def score(self, features: Callable[[str], Column]) -> Column:
        """Sum of the trees for a candidate, given its features by name."""
        return reduce(
            lambda total, tree: total + tree,
            [F.lit(w) * _tree(list(lines), features) for w, lines in zip(self.weights, self.trees)],
            F.lit(0.0),
        )

    def selects(self, span: Column, before: Column) -> Column:
        """Whether a candidate is personal data."""
        if not self.thresholds:
            return F.lit(False)
        bounds = F.coalesce(*[F.when(span["kind"] == k, F.lit(t)) for k, t in self.thresholds.items()])
        made = F.array(F.struct(*[v.alias(k) for k, v in _features(span, before).items()]))
        return F.get(F.transform(made, lambda f: self.score(lambda name: f[name]) >= bounds), F.lit(0)).eqNullSafe(True)


def _labelled(texts: DataFrame, label: Callable[[dict[str, Column], Column], Column]) -> DataFrame:
    """h, label, kind, found and what stands before it, of the labelled loose candidates of ``text``."""
    whole = F.col("text")
    spans = texts.where(whole.rlike("[0-9@]")).withColumn("spans", candidates(whole)["loose"]).where(F.size("spans") > 0)
    rows = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["found"].alias("found"), _before(s, whole).alias("before")))
    each = spans.select(*[c for c in texts.columns if c != "text"], F.inline(rows))
    says = label({name: F.col(name) for name in ("kind", "found")}, F.col("before")).alias("label")
    return each.select(F.xxhash64("found", "before").alias("h"), says, "kind", "found", "before").where("label is not null")


def _forms(rows: DataFrame) -> DataFrame:
    """part (whether held out), made, label, kind, features and n: how many candidates no cut tells apart.

    A feature is raised to the next cut, or to infinity above the last one.
    """

    def raised(name: str) -> Column:
        cuts = CUTS.get(name, (0,))
        to_cut = reduce(lambda case, cut: case.when(F.col(name) <= cut, float(cut)), cuts[1:], F.when(F.col(name) <= cuts[0], float(cuts[0])))
        return to_cut.otherwise(float("inf")).alias(name)

    span = {name: F.col(name) for name in ("kind", "found")}
    part = (F.pmod(F.shiftright("h", 7), F.lit(2)) == 0).alias("part")
    described = rows.select(part, "made", "label", "kind", *[v.alias(k) for k, v in _features(span, F.col("before")).items()])
    keys = ("part", "made", "label", "kind")
    formed = described.select(*keys, *map(raised, FEATURES)).groupBy(*keys, *FEATURES).agg(F.count("*").alias("n"))
    return formed.sortWithinPartitions(*keys, *FEATURES)


def examples(spark: SparkSession) -> DataFrame:
    """text and label of the made-up candidates; their digits are drawn from hashes."""
    forms = F.array(
        *[F.struct(F.lit(form).alias("form"), F.lit(label).alias("label")) for label, of in ((1.0, PERSONAL_FORMS), (0.0, OTHER_FORMS)) for form in of]
    )
    leads = F.array(*[F.lit(lead) for lead in LEADS])
    rows = spark.range(EXAMPLES).select("id", F.explode(forms).alias("f")).select("id", "f.form", "f.label")
    digit = lambda i, least: (F.pmod(F.xxhash64("id", "form", i), F.lit(10 - least)) + least).cast("string")
    drawn = F.transform(F.split("form", ""), lambda c, i: F.when(c == "#", digit(i, 0)).when(c == "&", digit(i, 1)).otherwise(c))
    lead = F.get(leads, F.pmod(F.xxhash64("id", "form"), F.lit(len(LEADS))).cast("int"))
    return rows.select(F.concat(lead, F.array_join(drawn, ""), F.lit(" and")).alias("text"), "label")


def _sample_texts(documents: DataFrame, text: str) -> DataFrame:
    """At most ``SAMPLE_TEXTS`` distinct texts that can hold a candidate, first by their hash; no query takes a sample."""
    whole = F.col(f"`{text}`")
    able = documents.select(whole.alias("text"), F.xxhash64(whole).alias("h")).where(whole.rlike("[0-9@]"))
    last = able.select("h").distinct().orderBy("h").limit(SAMPLE_TEXTS).agg(F.max("h")).first()[0]
    return able.where(F.lit(False) if last is None else F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text"))


def fitted(documents: DataFrame, text: str = "text", sample: int | None = None) -> Selector:
    """Trees and thresholds fitted on the made-up examples and on all candidates of all documents.

    With ``sample``, only on so many candidates, first by a hash of themselves and their context,
    in the distinct texts that come first by their hash.
    """
    texts = documents.select(F.col(f"`{text}`").alias("text")) if sample is None else _sample_texts(documents, text).select("text")
    own = _labelled(texts, _evidence).distinct()
    if sample is not None:
        own = own.orderBy("h", "label", "kind").limit(sample)
    made = _labelled(examples(documents.sparkSession), lambda span, before: F.col("label"))
    forms = stored(_forms(own.withColumn("made", F.lit(False)).unionByName(made.withColumn("made", F.lit(True)))), "pii-forms")
    sizes = forms.groupBy("part", "made", "kind", "label").agg(F.sum("n").alias("n")).collect()
    share = min(1.0, OWN_WEIGHT / max(1, sum(r.n for r in sizes if not r.made)))
    weighed = F.col("n") * F.when(F.col("made"), 1.0).otherwise(share)
    totals: dict[tuple[str, float], float] = {}
    for r in sizes:
        if r.part:
            totals[r.kind, r.label] = totals.get((r.kind, r.label), 0.0) + r.n * (1.0 if r.made else share)
    same = [F.when((F.col("kind") == kind) & (F.col("label") == label), F.lit(1000.0 / n)) for (kind, label), n in totals.items()]
    # As features of two values the steps are split without a sample that looks for bounds.
    steps = [
        (F.col(name) > cut).cast("double").alias(f"{name}_{cut}", metadata={"ml_attr": {"type": "binary"}}) for name, cut in STEPS
    ]
    rows = forms.where("part").select("label", (weighed * F.coalesce(*same)).alias("weight"), *steps)
    vectors = VectorAssembler(inputCols=[f"{name}_{cut}" for name, cut in STEPS], outputCol="features").transform(rows)
    booster = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=32, weightCol="weight")
    model = booster.fit(vectors.select("label", "weight", "features"))
    selector = Selector(model.toDebugString, list(model.treeWeights))
    selector.thresholds = _thresholds(forms.where("not part"), selector, share)
    return selector


def _thresholds(held_out: DataFrame, selector: Selector, share: float) -> dict[str, float]:
    """The lowest score of each generator from which on the selections are precise enough.

    ``share`` is the weight of a candidate that is not made up.
    """
    score = F.round(selector.score(F.col), 3)
    total = lambda made, label: F.sum(F.when((F.col("made") == made) & (F.col("label") == label), F.col("n")).otherwise(0))
    bins = (
        held_out.groupBy("kind", score.alias("score"))
        .agg(*[total(made, label).alias(f"{name}_{of}") for made, of in ((True, "made"), (False, "own")) for label, name in ((1, "right"), (0, "wrong"))])
        .orderBy("kind", F.desc("score"))
        .collect()
    )
    found: dict[str, float] = {}
    for kind in LOOSE:
        own = [(b.score, b.right_made + share * b.right_own, b.wrong_made + share * b.wrong_own) for b in bins if b.kind == kind]
        all_right, all_wrong = sum(b[1] for b in own), sum(b[2] for b in own)
        right = wrong = 0.0
        for bound, more_right, more_wrong in own:
            right, wrong = right + more_right, wrong + more_wrong
            hits = (right + SMOOTHING) / (all_right + 2 * SMOOTHING)
            misses = (wrong + SMOOTHING) / (all_wrong + 2 * SMOOTHING)
            if bound > 0 and hits / (hits + misses) >= PRECISION:
                found[kind] = bound
    return found


def spans_of(text: Column, selector: Selector) -> Column:
    """struct<base, spans>: spans of the fixed formats, and all spans in order."""
    loose = bool(selector.thresholds)
    whole = F.coalesce(text, F.lit(""))

    def chosen(found: Column) -> Column:
        base = found["base"]
        if not loose:
            return F.struct(base.alias("base"), base.alias("spans"))
        picked = F.filter(
            found["loose"],
            lambda s: ~s["hit"] & ~_evidence(s, _before(s, whole)).eqNullSafe(F.lit(0.0)) & selector.selects(s, _before(s, whole)),
        )
        added = F.transform(picked, lambda s: s.dropFields("hit"))
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, added)).alias("spans"))

    return F.get(F.transform(F.array(candidates(text, loose)), chosen), F.lit(0))


def with_spans(documents: DataFrame, selector: Selector, into: str, text: str = "text") -> DataFrame:
    """The documents with a struct column ``into``: base spans, and all spans in order."""
    return documents.withColumn(into, spans_of(F.col(f"`{text}`"), selector))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def of_kind(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with a tag in the place of each span; overlapping spans share the first tag."""
    parts = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda state, s: F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= state["at"],
                F.concat(
                    state["out"],
                    F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")),
                    F.lit("["), F.upper(s["kind"]), F.lit("]"),
                ),
            ).otherwise(state["out"]).alias("out"),
        ),
    )
    rest = F.substring(text, (parts["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(parts["out"], rest)).otherwise(text)


def redacted_documents(documents: DataFrame, selector: Selector) -> DataFrame:
    """The documents with personal data replaced by tags; n_chars follows where there is one."""
    numbered = Numbered(documents)
    text = numbered.name("text")
    found = with_spans(numbered.rows, selector, "found", text)
    found = found.withColumn(text, redacted(F.col(text), F.col("found.spans")))
    if "n_chars" in numbered:
        n_chars = numbered.name("n_chars")
        length = F.length(text).cast(documents.schema["n_chars"].dataType)
        found = found.withColumn(n_chars, F.when(F.size("found.spans") > 0, length).otherwise(F.col(n_chars)))
    return numbered.back(found)
