"""BPE against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
import small
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def assert_same(library, texts):
    model = bpe.WordBpe(PATH)
    wanted = library.encode_batch(texts, add_special_tokens=False)
    for text, packed, want in zip(texts, model.encode(texts), wanted):
        assert np.frombuffer(packed, "<u4").tolist() == want.ids, text
        assert model.decode(packed) == library.decode(want.ids, skip_special_tokens=False)


def test_awkward_texts(library):
    assert_same(
        library,
        [
            "", " ", "aaaa aaaaa", "The THE the.", "don't I'LL we've", "12345 ٣٤", "Σίσυφος ΣΑΣ", "<|endoftext|>",
            "a<|startoftext|>b <|endoftext", "\x1cx\x1f y\x85z  ", "é é ﬁ İ", "🎉👩‍👩‍👧", "ab" * 5000,
            "՘ \U00012550 \U00018e00a", "!!!...!!", "﻿x",
        ],
    )


def test_random_texts(library):
    rnd = random.Random(7)
    letters = list("aabbbthe ein'sS'12Σß İé́\n!~中") + ["<|endoftext|>", "'re", "aaa"]
    assert_same(library, ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(3000)])


def test_kept_words_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    model = bpe.WordBpe(PATH)
    for text in ("one two three four five", "six seven one", "two"):
        packed = model.encode([text])[0]
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(model.codes) <= 5


def test_awkward_rows(spark, library):
    rows = small.awkward(spark)
    found = rows.withColumn("bpe", bpe.encoded(F.col("text"))).collect()
    assert len(found) == rows.count()
    for r in found:
        assert np.frombuffer(r.bpe.ids, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
    assert small.empty(spark).select(bpe.encoded(F.col("text"))).count() == 0


def test_whole_table(spark, library):
    import hashlib

    sf_dir = "/root/testdata/sf0.001"
    rows = small.by_id(queries.op3_bpe_encode_decode(spark, sf_dir))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    for d in documents:
        ids = library.encode(d.text, add_special_tokens=False).ids
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        said = library.decode(ids, skip_special_tokens=False)
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
