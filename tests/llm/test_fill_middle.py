"""Cuts against a plain version over characters, and the index against Python's own encoding."""

import hashlib
import random
import re

import numpy as np
import pytest
import small
from pyspark.sql import functions as F

from shelfmark.llm import fill_middle

PIECES = ["a", "Z", "word", " ", "\n", "é", "ß", "中", "😀", "<P>", "<", "P", ">", "<S", "1", "́", "`", "{", "@", "["]


def plain(text, key, unit, plain_from=90, spm_below=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text) if unit == "word" else list(text)
    digest = hashlib.sha256(key.encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm_below:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def cut(documents, unit="word", **draws):
    key = F.concat(F.lit("1:"), F.col("doc_id").cast("string"))
    made = documents.select("*", fill_middle.transformed(F.col("text"), key, unit, **draws).alias("cut"))
    back = fill_middle.restored(F.col("cut.output"), F.col("cut.form"))
    return made.select("doc_id", "text", "cut.*", back.alias("back")).collect()


@pytest.mark.parametrize("unit", ["word", "character"])
def test_cuts_and_texts_rebuilt(spark, unit):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 30))) for _ in range(600)]
    texts += [None, "", "a", "😀", "é" * 3000, "ab" * 50_000 + "中" + "x y " * 20_000]
    rows = cut(small.documents(spark, texts), unit)
    assert len(rows) == len(texts)
    for r in rows:
        wanted = plain(r.text, f"1:{r.doc_id}", unit)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == wanted
        assert r.back == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_runs_do_not_touch(spark, monkeypatch):
    texts = ["ab", "cd", "", "é", "e", None, "f g"] * 30
    monkeypatch.setattr(fill_middle, "RUN_BYTES", 5)
    run = [fill_middle.Run([(t or "").encode() for t in part], "word") for part in (texts, ["", ""])]
    assert run[0].n_units.tolist() == [len(re.findall("[A-Za-z]+|[^A-Za-z]", t or "")) for t in texts]
    assert run[1].n_units.tolist() == [0, 0]


def test_index_converts_both_ways():
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choices(PIECES, k=rnd.randint(0, 60)))
        index = fill_middle.MultibyteIndex(np.frombuffer(text.encode(), np.uint8))
        points = np.arange(len(text) + 1)
        places = np.array([len(text[:k].encode()) for k in points])
        assert index.bytes(points).tolist() == places.tolist()
        assert index.points(places).tolist() == points.tolist()
        assert len(index.byte_at) == sum(ord(c) > 127 for c in text)  # ASCII leaves no entry


def test_shares_are_parameters(spark):
    documents = small.documents(spark, ["some plain words"] * 50)
    assert {r.form for r in cut(documents, plain_from=0)} == {"plain"}
    assert {r.form for r in cut(documents, plain_from=100, spm_below=100)} == {"spm"}
    with pytest.raises(ValueError):
        fill_middle.Run([b"a"], "line")


def test_awkward_and_empty_tables(spark):
    for documents in (small.awkward(spark), small.empty(spark)):
        made = documents.withColumn("cut", fill_middle.transformed(F.col("text"), F.col("doc_id").cast("string")))
        rows = made.collect()
        assert len(rows) == documents.count() and made.columns == [*documents.columns, "cut"]
        for r in rows:
            assert r.cut.output is not None and (r.text or r.cut.form == "plain")
