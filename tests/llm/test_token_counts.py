"""Counts against the tokenizers library's unigram model."""

import random

import public_tokenizers
import pytest
import sentencepiece
import small
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from shelfmark.llm import queries, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    return Tokenizer(models.Unigram(pieces, 0, True))


def library_count(library, text):
    return len(library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


def test_random_texts(library):
    model, rnd = token_counts.from_sentencepiece(PATH), random.Random(3)
    letters = list("aabbeettthinos  .,1é中🎉\x01\n") + ["<s>", "the ", "ing", "▁", "<0x41>"]
    for _ in range(4000):
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 50)))
        assert model.total(text) == library_count(library, text), text


def test_ties_and_unknown_stretches():
    rnd = random.Random(6)
    for byte_pieces in (False, True):
        for _ in range(60):
            pieces = {"".join(rnd.choices("ab▁", k=rnd.randint(1, 4))): float(rnd.randint(-3, 0)) for _ in range(8)}
            vocabulary = [("<unk>", -9.0)] + list(pieces.items())
            if byte_pieces:
                vocabulary += [(f"<0x{b:02X}>", -9.0) for b in range(256)]
            model = token_counts.Unigram(vocabulary, byte_pieces)
            library = Tokenizer(models.Unigram(vocabulary, 0, byte_pieces))
            for _ in range(30):
                text = "".join(rnd.choices("aabbcé ", k=rnd.randint(1, 12)))
                assert model.total(text) == library_count(library, text), (vocabulary, text)


def test_whole_table_and_awkward_rows(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    rows = small.by_id(queries.op6_token_counts(spark, sf_dir))
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert rows[d.doc_id].n_tokens == library_count(library, d.text)
    for r in small.awkward(spark).withColumn("n", token_counts.counted(F.col("text"))).collect():
        assert r.n == library_count(library, r.text or "")
    assert small.empty(spark).select(token_counts.counted(F.col("text"))).count() == 0
