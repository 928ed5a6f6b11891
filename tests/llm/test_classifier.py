"""Votes, estimates, posteriors and scores against plain versions, held-out accuracy of the scorer."""

import math
import random
import re

import small
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from shelfmark.llm import classifier


def test_em_recovers_accuracies():
    rnd = random.Random(3)
    accuracy, patterns = [0.9, 0.8, 0.7, 0.6, 0.85], {}
    for _ in range(20000):
        good = rnd.random() < 0.7
        votes = tuple(0 if rnd.random() < 0.2 else (1 if (rnd.random() < a) == good else -1) for a in accuracy)
        patterns[votes] = patterns.get(votes, 0) + 1
    share, chances = classifier.estimated(patterns)
    assert abs(share - 0.7) < 0.03
    for a, chance in zip(accuracy, chances):
        assert abs(chance[1][0] / (chance[1][0] + chance[-1][0]) - a) < 0.04


TEXTS = [
    "The house of the river is in the valley. It was for that reason on the map, and the road to it is long. " * 2,
    "AAA BBB!! CCC!! DDD!! EEE!! FFF!!", "a | b | c | d | e |", "x### y$$$ z%%% w&&& #### ****", "", None, "one", "same same same same same",
    "der und die das ist mit den von haus. baum und wald sind in der nacht. das ist es. " * 3, "no. stops. here. and there. " * 12,
    "zq xv wk " * 20, "line\nline\nline\nline\nline " * 9, "What is it? The thing. In the end? A la de que en los.", "\t\n ", "word " * 60,
]


def plain_votes(text):
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    n = len(words)
    of = lambda characters, whole: sum(c in characters for c in text) / max(whole, 1)
    junk = lambda yes: -1 if yes else 0
    sentences = re.split(r"[.\n]+", text)
    common = sum(w.lower() in classifier.COMMON for w in words) / max(n, 1)
    stops = of(".?", n)
    return (
        junk(of("#*$%&<>", n) > 0.3), junk(of("|", n) > 0.2), junk(of("!", n) > 0.3),
        junk(of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", len(text)) > 0.4), junk(n > 20 and len(set(sentences)) / len(sentences) < 0.5),
        junk(len(set(words)) / max(n, 1) < 0.3), -1 if stops < 0.01 else 1 if 0.03 < stops < 0.4 else 0,
        -1 if n > 20 and common < 0.02 else 1 if common > 0.12 else 0,
    )


def plain_em(votes, rounds):
    """Document by document, no counts of patterns."""
    good = [1 / (1 + math.exp(-2.0 * sum(v))) for v in votes]
    for _ in range(rounds):
        share = (sum(good) + 1) / (len(votes) + 2)
        chance = [
            {
                v: tuple(
                    (1 + sum(w for w, row in zip(weights, votes) if row[k] == v)) / (3 + sum(weights))
                    for weights in (good, [1 - g for g in good])
                )
                for v in (-1, 0, 1)
            }
            for k in range(len(votes[0]))
        ]
        good = []
        for row in votes:
            yes = share * math.prod(c[v][0] for v, c in zip(row, chance))
            no = (1 - share) * math.prod(c[v][1] for v, c in zip(row, chance))
            good.append(yes / (yes + no))
    return share, chance, good


def test_votes_estimates_and_posteriors_are_the_plain_ones(spark):
    texts = TEXTS * 3 + TEXTS[:4] * 5
    documents = small.documents(spark, [t or "" for t in texts])
    named = classifier.votes(F.col("text"), classifier._words(F.col("text")))
    rows = documents.select("doc_id", *[v.alias(k) for k, v in named.items()]).orderBy("doc_id").collect()
    votes = [tuple(r[k] for k in named) for r in rows]
    assert votes == [plain_votes(t or "") for t in texts]
    patterns = {v: votes.count(v) for v in votes}
    share, chance, good = plain_em(votes, classifier.ROUNDS)
    found_share, found = classifier.estimated(patterns)
    assert math.isclose(found_share, share, rel_tol=1e-9)
    for ours, wanted in zip(found, chance, strict=True):
        assert all(math.isclose(a, b, rel_tol=1e-9) for v in wanted for a, b in zip(ours[v], wanted[v]))
    belief = classifier.posterior(named, found_share, found)
    after = [r.b for r in documents.select("doc_id", belief.alias("b")).orderBy("doc_id").collect()]
    # The estimates' last step is the posterior under them.
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(after, good))


def test_scores_are_the_plain_ones(spark):
    documents = small.documents(spark, TEXTS * 4)
    model = classifier.fitted(documents)
    index = HashingTF(numFeatures=classifier.BUCKETS).indexOf
    weights = model.coefficients.toArray()
    for i, r in small.by_id(classifier.scored(documents, model, "score")).items():
        text = r.text or ""
        shape = re.sub(r"([^\s])\1+", r"\1\1", re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", text))))
        cut = lambda t: [w for w in re.split(r"[ \t-\r]+", t) if w]
        counts = {}
        for term in [*cut(text.lower()), *("\u0001" + w for w in cut(shape))]:
            counts[index(term)] = counts.get(index(term), 0) + 1
        length = math.sqrt(sum(n * n for n in counts.values())) or 1.0
        z = model.intercept + sum(weights[k] * n / length for k, n in counts.items())
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), abs_tol=1e-9), text


def test_no_documents():
    assert classifier.estimated({}) == (0.5, [])


def test_scores_agree_with_labels_never_seen(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = classifier.fitted(documents, sample=3000)
    scores = classifier.scored(documents, model, "score").join(labels, "doc_id").select("quality", "score").collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in scores)
    assert right / len(scores) > 0.9
    clean = [r.score >= 0.5 for r in scores if r.quality == 1]
    assert sum(clean) / len(clean) > 0.97


def test_awkward_rows(spark):
    rows = small.awkward(spark).withColumn("label", F.lit("x")).withColumn("score", F.lit("old"))
    scored = classifier.scored(rows, classifier.fitted(rows), "score")
    assert sorted(scored.columns) == sorted(rows.columns) and scored.count() == 9
    assert all(0 <= r.score <= 1 for r in scored.collect())
    none = small.empty(spark)
    assert classifier.scored(none, classifier.fitted(none), "score").count() == 0
