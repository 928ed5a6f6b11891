"""Counts against brute force, Viterbi against all labellings, held-out accuracy of the verdict."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import small
from pyspark.sql import functions as F

from shelfmark.llm import quality_rules as rules
from shelfmark.llm import queries

SF_DIR = "/root/testdata/sf0.01"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(inside),
        "base_failed": n < 50 or 100 * len(inside) > 50 * n,
    }


def judge(spark, texts, model=None):
    rows = small.documents(spark, texts).select("doc_id", rules.judged(F.col("text"), model or rules.LineField()).alias("r"))
    return small.by_id(rows.select("doc_id", "r.*"))


def test_counts(spark):
    rnd = random.Random(2)
    texts = ["", None, "a", "a b c a b c", "x\n\nx\n x\nx ", "é|<>\x1c y\x0bz", "a a a a a a", "\n\n"]
    texts += ["".join(rnd.choices("ab c\n#é", k=rnd.randint(0, 80))) for _ in range(200)]
    texts.append(" ".join(rnd.choices("abcdef", k=400)))
    rows = judge(spark, texts)
    for i, text in enumerate(texts):
        assert {k: rows[i][k] for k in plain_counts(text)} == plain_counts(text), text
        assert len(rows[i].line_labels) == (text or "").count("\n") + 1
        assert not (rows[i].kept and rows[i].base_failed)


def test_long_vocabularies_keep_products_apart():
    words = [str(i).encode() for i in range(3000)] * 2
    assert rules.repeated_words(words) == 6000


def test_viterbi_finds_the_best_labels():
    rnd = np.random.default_rng(1)
    model = rules.LineField(rnd.normal(size=3), rnd.normal(size=(2, 2)))
    for n in range(1, 9):
        x = rnd.normal(size=(n, 3))

        def score(labels):
            return sum((x[i] @ model.weights) * y for i, y in enumerate(labels)) + sum(
                model.steps[a, b] for a, b in zip(labels, labels[1:])
            )

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert np.isclose(score(model.decode(x)), score(best))


def test_marginals_are_sums_over_all_labellings():
    rnd = np.random.default_rng(6)
    lengths = [4, 1, 6, 3, 6]
    scores, steps = [rnd.normal(size=(n, 1)) for n in lengths], rnd.normal(size=(2, 2))
    chains = rules.Chains(scores)
    single, pairs = chains.marginals([x[:, 0] for x in chains.rows], steps)
    for at, i in enumerate(chains.order):
        n, x = lengths[i], scores[i][:, 0]
        one, two, total = np.zeros(n), np.zeros((n, 2, 2)), 0.0
        for labels in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(x * labels) + sum(steps[a, b] for a, b in zip(labels, labels[1:])))
            total += p
            one += p * np.array(labels)
            for t in range(1, n):
                two[t, labels[t - 1], labels[t]] += p
        assert np.allclose([single[t][at] for t in range(n)], one / total)
        assert all(np.allclose(pairs[t][at], two[t] / total) for t in range(1, n))


def test_fit_finds_the_lines_that_labels_only_bound():
    """Bad texts hold a few good lines and good texts a few bad ones; no line is labelled."""
    rnd = np.random.default_rng(4)
    texts, bad, truth = [], [], []
    for doc in range(400):
        lines = np.array([rnd.random() < (0.85 if doc % 2 else 0.1) for _ in range(rnd.integers(2, 9))], int)
        texts.append(np.hstack([np.ones((len(lines), 1)), rnd.normal(4 * lines[:, None] - 2, 1, (len(lines), 2))]))
        bad.append(doc % 2)
        truth.append(lines)
    model = rules.fit(texts, np.array(bad))
    found = [np.array(model.decode(x)) for x in texts]
    right = np.concatenate([a == b for a, b in zip(found, truth)])
    assert right.mean() > 0.95
    assert sum(0 < y.mean() < 1 for y in found) > 0.25 * len(texts)  # labels differ inside documents


def test_seeds_stand_between_different_lines():
    menu, copied = 1, [10, 11, 12, 13]
    texts = [np.array([100 + k, menu, 200 + k, 0, 300 + k]) for k in range(4)] + [np.array(copied)] * 5
    found = rules.seeds(texts)
    assert all(x.tolist() == [False, True, False, False, False] for x in found[:4])
    assert not any(x.any() for x in found[4:])


@pytest.mark.parametrize("lengths", [[4, 1, 6, 3, 6], [1], [1, 1], [700, 2, 300, 1]])
def test_chances_in_runs_equal_the_plain_way(lengths):
    rnd = np.random.default_rng(7)
    scores, steps = [4 * rnd.normal(size=(n, 1)) for n in lengths], rnd.normal(size=(2, 2))
    chains = rules.Chains(scores)
    single, pairs = chains.marginals([x[:, 0] for x in chains.rows], steps)
    starts = np.cumsum(lengths) - lengths
    first = np.zeros(sum(lengths), bool)
    first[starts] = True
    one, two = rules.chances(np.concatenate(scores)[:, 0], first, steps)
    for at, i in enumerate(chains.order):
        assert np.allclose([single[t][at] for t in range(lengths[i])], one[starts[i] :][: lengths[i]])
        assert all(np.allclose(pairs[t][at], two[:, :, starts[i] + t]) for t in range(1, lengths[i]))
    assert not two[:, :, first].any()


def labelled(spark, texts, bad):
    labels = [(i, 1 - int(b), 0) for i, b in enumerate(bad)]
    return small.documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def some_texts(count, lines, rnd):
    """Texts of about so many lines, one in three of them bad, and which are."""
    good, odd = ["a plain line that says something.", "and one more, of some words.", "Yes"], ["### 12 $$", "BUY | NOW !", "x | y | z"]
    bad = [i % 3 == 0 for i in range(count)]
    return ["\n".join(f"{rnd.choice(odd if b else good)} {rnd.randint(0, 99)}" for _ in range(lines)) for b in bad], bad


def same(a, b):
    return np.allclose(a.weights, b.weights, atol=1e-9) and np.allclose(a.steps, b.steps, atol=1e-9)


def test_every_labelled_document_counts(spark):
    """Leaving out one of 4,100 documents changes the weights, wherever its hash puts it."""
    documents, labels = labelled(spark, *some_texts(4100, 2, random.Random(8)))
    model = rules.fitted(documents, labels)
    last = labels.orderBy(F.xxhash64("doc_id").desc()).first().doc_id
    assert not same(model, rules.fitted(documents, labels.where(F.col("doc_id") != last)))


def test_long_documents_count(spark):
    model = rules.fitted(*labelled(spark, *some_texts(30, 300, random.Random(9))))
    assert not same(model, rules.LineField())


@pytest.mark.parametrize("least", [5, 1000])
def test_blocks_against_fits_in_memory(spark, monkeypatch, least):
    """Weights are the mean over blocks of all texts; a rare label goes into each. Repeated rows count once."""
    monkeypatch.setattr(rules, "BLOCK_TEXTS", 40)
    monkeypatch.setattr(rules, "LEAST_TEXTS", least)
    texts, bad = some_texts(150, 3, random.Random(10))
    documents, labels = labelled(spark, texts, bad)
    model = rules.fitted(documents.unionByName(documents.limit(20)), labels)
    hashes = small.by_id(documents.select("doc_id", F.xxhash64("doc_id", "text").alias("h")))
    split = [rules._split(t)[1:] for t in texts]
    seeded = rules.seeds([rules.line_hashes(*s) for s in split])
    parts = {b: min(4, max(1, bad.count(b) // least)) for b in (False, True)}
    found = []
    for block in range(4):
        # A label with fewer parts than blocks comes round again.
        own = [i for i in range(150) if block % parts[bad[i]] == hashes[i].h % parts[bad[i]]]
        own.sort(key=lambda i: hashes[i].h)
        lines = [rules.line_features(*split[i]).astype("<f4").astype(float) for i in own]
        found.append((len(own), rules.fit(lines, np.array([int(bad[i]) for i in own]), [seeded[i] for i in own])))
    mean = lambda of: sum(n * of(m) for n, m in found) / sum(n for n, _ in found)
    assert same(model, rules.LineField(mean(lambda m: m.weights), mean(lambda m: m.steps)))
    assert any(x.any() for x in seeded)


PLANTS = [
    "Home | About | Contact | Login", "Copyright 2024 Example Ltd. All rights reserved.", "### *** $$$ ### %%% &&&",
    "CLICK HERE!! BUY NOW!! WIN!! FREE!!", "Subscribe to our newsletter", "Terms | Privacy Policy | Cookies",
    "This work is licensed under the GNU General Public License, version 3.",
]


def test_planted_lines_in_good_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0
    model = rules.fitted(documents, labels.where(half))
    rnd = random.Random(3)
    hit, others, lines, mixed = [], 0, 0, 0
    for r in documents.join(labels.where(~half & (F.col("quality") == 1)), "doc_id").select("text").collect():
        text = (r.text or "").split("\n")
        if len(text) < 3:
            continue
        at = rnd.randint(0, len(text))
        text.insert(at, rnd.choice(PLANTS))
        _, split, words = rules._split("\n".join(text))
        found = model.decode(rules.line_features(split, words))
        hit.append(found.pop(at))
        others, lines = others + sum(found), lines + len(found)
        mixed += len({y for y, w in zip(found, words[:at] + words[at + 1 :]) if w}) > 1
    assert len(hit) > 1000 and sum(hit) / len(hit) > 0.9 and others / lines < 0.05
    assert mixed  # lines are labelled apart from their documents


@pytest.fixture(scope="module")
def verdicts(spark):
    return small.by_id(queries.op2_quality_rules(spark, SF_DIR))


def test_whole_table_counts(spark, verdicts):
    for d in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        assert {k: verdicts[d.doc_id][k] for k in plain_counts(d.text)} == plain_counts(d.text)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0
    model = rules.fitted(documents, labels.where(half))
    judged = documents.join(labels.where(~half), "doc_id").select("quality", rules.judged(F.col("text"), model).alias("r"))
    rows = judged.where(~F.col("r.base_failed")).select("quality", "r.kept").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows)
    assert len(rows) > 500 and right / len(rows) > 0.97
    clean = [r.kept for r in rows if r.quality == 1]
    assert sum(clean) / len(clean) > 0.98


def test_no_labels_and_awkward_rows(spark):
    documents = small.awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        model = rules.fitted(documents, labels)
        assert np.array_equal(model.weights, rules.LineField().weights) and np.array_equal(model.steps, rules.LineField().steps)
        kept = rules.kept_documents(documents, model)
        assert kept.columns == documents.columns
        assert {r.doc_id for r in kept.collect()} <= {3, 4}
    assert rules.kept_documents(small.empty(spark), rules.LineField()).count() == 0
