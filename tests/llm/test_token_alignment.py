"""Groups, links and counts against plain versions that use the libraries directly."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import small
from tokenizers import Tokenizer

from shelfmark.llm import token_alignment as align

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def plain_bytes(libraries):
    """Bytes of each entry, by the decoders of the file formats."""
    a, b = libraries
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    of_a = lambda i: bytes(table[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return of_a, of_b


def plain(texts, libraries):
    """Rows of all texts, every pair of tokens of a text compared."""
    a, b = libraries
    of_a, of_b = plain_bytes(libraries)
    rows, holders = [], Counter()
    for text in texts:
        spaced = " " + (text or "")
        ids_a, ids_b = a.encode(spaced, add_special_tokens=False).ids, b.encode(text or "")
        if not text or b"".join(map(of_a, ids_a)) != spaced.encode() or b"".join(map(of_b, ids_b)) != spaced.encode():
            rows.append(([], [], [], ""))
            continue
        ranges = []
        for ids, of in ((ids_a, of_a), (ids_b, of_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of(i)), i))
                at += len(of(i))
            ranges.append(own)
        links = [(i, j) for s, e, i in ranges[0] for t, f, j in ranges[1] if s < f and t < e]
        cuts = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in own if before < e <= cut) for own in ranges))
            before = cut
        rows.append((ids_a, ids_b, links, ";".join(groups)))
        holders.update(set(links))
    best = defaultdict(int)
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    return [
        (
            len(ids_a), len(ids_b), groups.count(";") + 1 if groups else 0, len(links),
            sum(holders[l] == best[l[0]] for l in links), sum(holders[l] for l in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for ids_a, ids_b, links, groups in rows
    ]


def compare(spark, texts, libraries):
    rows = small.documents(spark, texts)
    found = {r.id: r for r in align.Alignment(rows, "doc_id").documents.collect()}
    assert len(found) == len(texts)
    for i, wanted in enumerate(plain(texts, libraries)):
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == wanted, texts[i]


ODD = [
    None, "", " ", "  ", "\n\n  x", "a", "it's '''s don't  we'll", "<|endoftext|> and <s> </s> <unk> <0x0A>", "▁ one▁two",
    "😀中文 Ünïcode é é", "͸ unassigned \U000E0001 ࢏ letters", "x" * 3000, " \t \r\n" * 40, "ſt ﬁ ½ ① Ａ", "\x00\x01", "1234567890" * 9,
]


def test_odd_texts(spark, libraries):
    compare(spark, ODD, libraries)


def test_made_up_texts_over_many_blocks(spark, libraries):
    rnd = random.Random(7)
    pieces = ["the", " the", " quick", "brown", " ", "  ", "\n", "é", "中", "<s>", "'s", "42", "tokenization", " Über", "\t"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randint(0, 25))) for _ in range(150)] + ["copy of the copy"] * 40
    compare(spark, texts, libraries)


def test_rows_of_the_given_table(spark, libraries):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    texts = [t for t in texts if len(t or "") < 4000]
    compare(spark, texts, libraries)


def test_the_file_is_read_as_its_library_reads_it(libraries):
    """All texts of a table, and every code point between letters, digits and spaces."""
    ours = align.loaded(A_PATH, B_PATH).a
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    texts = [f" {t or ''}" for t in table + ODD]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{c}a1{c} {c}\n" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    texts += ["x" * 100_000, " " * 100_000 + "a", "\n " * 50_000]
    for mine, wanted in zip(ours.encode(texts), libraries[0].encode_batch(texts, add_special_tokens=False)):
        assert mine.tolist() == wanted.ids


def test_gallop_is_a_rank():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        long = np.unique(rnd.integers(1, 400, rnd.integers(1, 90)))
        short = np.unique(np.append(rnd.choice(long, rnd.integers(0, len(long))), [rnd.integers(1, long[-1] + 1), long[-1]]))
        short = short[short <= long[-1]]
        guess = rnd.integers(0, len(long), len(short))
        assert align.gallop(short, long, guess).tolist() == np.searchsorted(long, short).tolist()


def test_pairs_and_blocks(spark, monkeypatch):
    texts = ["one two three", "one two", "one", None, "one two three"] * 20
    whole = align.Alignment(small.documents(spark, texts), "doc_id")
    counts = {(r.a_id, r.b_id): r.n_documents for r in whole.pairs.collect()}
    assert max(counts.values()) == 80 and len(counts) == whole.pairs.count()
    assert whole.blocks.where("pairs IS NOT NULL").count() == whole.blocks.select("block").distinct().count()
    parts = align.Alignment(small.documents(spark, texts).repartition(37), "doc_id")
    assert sorted(map(str, parts.documents.collect())) == sorted(map(str, whole.documents.collect()))


def test_awkward_and_empty_tables(spark):
    documents = small.awkward(spark)
    found = align.Alignment(documents, "doc_id").documents
    assert sorted(str(r.id) for r in found.collect()) == sorted(str(r.doc_id) for r in documents.collect())
    assert align.Alignment(small.empty(spark), "doc_id").documents.count() == 0
    assert found.schema["id"].dataType == documents.schema["doc_id"].dataType
