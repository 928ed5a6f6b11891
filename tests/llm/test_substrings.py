"""Repeated windows against brute force."""

import random
from collections import Counter

import small

from shelfmark.llm import substrings


def plain_kept(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append([x for k, x in enumerate(w) if k not in gone])
    return words, out


def check(spark, texts, window, shortest):
    repeats = substrings.Repeats(small.documents(spark, texts), "doc_id", window=window, shortest=shortest)
    found = repeats.passages.select("key", "digest", "found.*")
    rows = small.by_id(repeats.rows.select("doc_id", "key", "digest", "n_words").join(found, ["key", "digest"], "left"))
    words, kept = plain_kept(texts, window)
    for i in range(len(texts)):
        assert rows[i].n_words == len(words[i])
        removed = rows[i].n_removed or 0
        assert removed == len(words[i]) - len(kept[i]), (i, texts[i][:200])
        if removed:
            assert rows[i].kept.encode() == b" ".join(kept[i])
            assert sum(s.end - s.start for s in rows[i].removed) == removed


def test_lengths():
    assert substrings.lengths(35) == [9, 18, 35]
    assert substrings.lengths(4, 9) == [4]


def test_random_texts_with_shared_passages(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("a b c d e".split()) + str(rnd.randrange(40))
    passages = [[word() for _ in range(rnd.randint(5, 40))] for _ in range(8)]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rnd.randint(0, 6)):
            words += [word() for _ in range(rnd.randint(0, 25))]
            if rnd.random() < 0.5:
                p = rnd.choice(passages)
                a = rnd.randrange(len(p))
                words += p[a:]
        texts.append(" ".join(words))
    texts += texts[:5]
    check(spark, texts, 12, 3)
    check(spark, texts, 8, 9)


def test_periodic_texts(spark):
    texts = ["x y " * 30, "p q r s t u v " * 9, "a " * 50, " ".join(f"u{i}" for i in range(60)), "one two"]
    check(spark, texts, 12, 3)
    check(spark, [" ".join(f"v{i % 41}" for i in range(90)), "k " * 34, "m " * 36], 35, 9)


def test_a_passage_of_exactly_the_window(spark):
    passage = [f"s{i}" for i in range(35)]
    a = [f"a{i}" for i in range(40)]
    texts = [" ".join(a[:20] + passage + a[20:]), " ".join([f"b{i}" for i in range(9)] + passage), " ".join(passage[:34] + a[:3])]
    check(spark, texts, 35, 9)


def test_awkward_rows(spark):
    rows = small.awkward(spark)
    assert substrings.without_repeats(small.empty(spark)).count() == 0
    left = substrings.without_repeats(rows)
    assert left.columns == rows.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(
        (r.doc_id, "" if r.doc_id in (3, 4) else r.text) for r in rows.collect()
    )
