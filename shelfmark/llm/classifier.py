"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. How often each pattern of
votes occurs is counted over all documents; from these counts expectation-maximisation
estimates how often each labeller is right for either class, and the share of good documents.
The posterior labels of a bounded sample train a linear scorer on hashed words and word
shapes, which then scores every document.

Rows: a null text is empty, most labellers call it bad. Repeated rows count and are scored
each on their own; ids may be null or repeated; other columns pass through untouched, an
empty table gives an empty one (without documents the scorer keeps everything).
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored

#: Bound of the sample of documents that the scorer is fitted on.
SAMPLE = 6_000
BUCKETS = 1 << 15
ROUNDS = 50
#: Common words of the languages at hand (fixed values).
COMMON = "the of and to in is that it for on was der die und den das ist mit de la el que en los le les des et est un une del y".split()
WORK = "__words"


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def votes(text: Column, words: Column) -> dict[str, Column]:
    """Vote of each labeller: 1 good, -1 bad, 0 nothing.

    A labeller that looks for one kind of junk says nothing about a text without it.
    """

    def vote(bad: Column, good: Column | bool = False) -> Column:
        return F.when(bad, -1).when(F.lit(good) if isinstance(good, bool) else good, 1).otherwise(0).cast("int")

    n = F.size(words)
    stops = _share(_without(text, ".?"), n)
    sentences = F.split(text, r"[.\n]+")
    common = _share(F.size(F.filter(words, lambda w: F.lower(w).isin(COMMON))), n)
    return {
        "symbols": vote(_share(_without(text, "#*$%&<>"), n) > 0.3),
        "bars": vote(_share(_without(text, "|"), n) > 0.2),
        "shouts": vote(_share(_without(text, "!"), n) > 0.3),
        "capitals": vote(_share(_without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.length(text)) > 0.4),
        "lines": vote((n > 20) & (_share(F.size(F.array_distinct(sentences)), F.size(sentences)) < 0.5)),
        "repeats": vote(_share(F.size(F.array_distinct(words)), n) < 0.3),
        "stops": vote(stops < 0.01, (stops > 0.03) & (stops < 0.4)),
        "common": vote((n > 20) & (common < 0.02), common > 0.12),
    }


Chances = list[dict[int, tuple[float, float]]]


def estimated(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, Chances]:
    """Share of good documents, and each labeller's chance of each vote by class (good, bad).

    ``patterns`` are the votes with their numbers of documents: at most 3 to the power of the
    labellers, however many documents there are. The first guess is the majority of the votes
    that were cast; from there on a vote counts by how much likelier one class makes it.
    """
    total = sum(patterns.values())
    width = len(next(iter(patterns), ()))
    belief = {p: 1 / (1 + math.exp(-2.0 * sum(p))) for p in patterns}
    good: float = 0.5
    chances: Chances = [{v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for _ in range(width)]
    for _ in range(rounds if total else 0):
        mass = sum(n * belief[p] for p, n in patterns.items())
        good = (mass + 1) / (total + 2)
        for k in range(width):
            for v in (-1, 0, 1):
                right = sum(n * belief[p] for p, n in patterns.items() if p[k] == v)
                wrong = sum(n * (1 - belief[p]) for p, n in patterns.items() if p[k] == v)
                chances[k][v] = ((right + 1) / (mass + 3), (wrong + 1) / (total - mass + 3))
        for p in patterns:
            odds = math.log(good / (1 - good)) + sum(math.log(c[v][0] / c[v][1]) for v, c in zip(p, chances))
            belief[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return good, chances


def posterior(named: dict[str, Column], good: float, chances: Chances) -> Column:
    """Probability that a document is good, given its votes."""
    odds = F.lit(math.log(good / (1 - good)))
    for vote, chance in zip(named.values(), chances):
        weight = {v: math.log(a / b) for v, (a, b) in chance.items()}
        odds = odds + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(weight[0])
    return 1 / (1 + F.exp(-odds))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def _hashed(documents: DataFrame, text: Column) -> DataFrame:
    """Words and word shapes of a text, hashed into a unit vector ``features``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shapes = F.regexp_replace(F.translate(text, upper + lower + "0123456789", "A" * 26 + "a" * 26 + "0" * 10), r"([^\s])\1+", "$1$1")
    terms = F.concat(_words(F.lower(text)), F.transform(_words(shapes), lambda s: F.concat(F.lit("\u0001"), s)))
    counted = HashingTF(numFeatures=BUCKETS, inputCol=WORK, outputCol="__counts").transform(documents.withColumn(WORK, terms))
    return Normalizer(inputCol="__counts", outputCol="features").transform(counted).drop(WORK, "__counts")


def fitted(documents: DataFrame, text: str = "text", sample: int = SAMPLE) -> LogisticRegressionModel | None:
    """A scorer fitted on the posterior labels of at most ``sample`` documents.

    The sample are the documents that come first by a hash of their text; copies count once.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    split = documents.select(whole.alias("text"), _words(whole).alias(WORK))
    named = votes(F.col("text"), F.col(WORK))
    voted = stored(
        split.select(F.xxhash64("text").alias("h"), *[v.alias(k) for k, v in named.items()]), "votes"
    )
    patterns = {
        tuple(row[k] for k in named): row["n"] for row in voted.groupBy(*named).agg(F.count("*").alias("n")).collect()
    }
    good, chances = estimated(patterns)
    belief = posterior({k: F.col(k) for k in named}, good, chances)
    chosen = voted.groupBy("h").agg(F.first(belief).alias("belief")).orderBy("h").limit(sample)
    texts = documents.select(whole.alias("text")).withColumn("h", F.xxhash64("text"))
    # At most ``sample`` rows of two numbers.
    rows = texts.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("text").alias("text"), F.first("belief").alias("belief"))
    both = _hashed(rows, F.col("text")).select(
        "features",
        F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("label"), F.col("belief").alias("weight")),
                F.struct(F.lit(0.0).alias("label"), (1 - F.col("belief")).alias("weight")),
            )
        ),
    )
    both = stored(both.where("weight > 0.001"), "weak-labels")
    if both.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(weightCol="weight", regParam=0.02, maxIter=40).fit(both)


def scored(documents: DataFrame, model: LogisticRegressionModel | None, into: str, text: str = "text") -> DataFrame:
    """The documents with ``into``, the probability that a document is good (1 without a model)."""
    if model is None:
        return documents.withColumn(into, F.lit(1.0))
    names = [f"c{i}" for i in range(len(documents.columns))]  # the model's own column names may clash
    renamed = documents.toDF(*names)
    whole = F.coalesce(F.col(names[documents.columns.index(text)]), F.lit(""))
    scores = model.transform(_hashed(renamed, whole))
    return scores.select(
        *[F.col(n).alias(c) for n, c in zip(names, documents.columns) if c != into],
        F.element_at(vector_to_array("probability"), 2).alias(into),
    )
