"""Fingerprints, Golay keys, links and groups against brute force."""

import random
from collections import Counter

import numpy as np
import small
import xxhash

from shelfmark.llm import queries, simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    """Smallest index reachable over links of two or fewer bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    for text in ("", "one", "One TWO", "a b c d", "É é x\ty\nz", "a b c a b c a b c"):
        assert simhash.fingerprint_of(text) == plain_fingerprint(text)


def test_golay_code_is_perfect():
    index = simhash.nearest()
    assert set(Counter(index.tolist()).values()) == {2048} and len(set(index.tolist())) == 4096


def test_keys_meet_all_pairs_at_two_bits():
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    pairs = [(b, b ^ (1 << i) ^ (1 << j)) for b in base for i in range(64) for j in range(i + 1)]
    keys = simhash.keys_of(np.array([x for p in pairs for x in p], np.uint64))
    assert all(np.intersect1d(keys[2 * k], keys[2 * k + 1]).size for k in range(len(pairs)))
    assert max(map(len, keys)) <= 18


def test_links_reach_what_brute_force_reaches(spark):
    rnd = random.Random(9)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for _ in range(160):  # chains and dense clusters
        fps.append(rnd.choice(fps) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    dense = rnd.getrandbits(64)
    fps += [dense ^ (1 << b) for b in range(60)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    wanted = plain_groups(fps)
    for key_rows in (1, 4, 1000):  # all through single bits, mixed, all through pairs
        edges = simhash.links(frame, key_rows)
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
        root = {r.node: r.root for r in simhash.components(edges).collect()}
        groups = {}
        for f, w in zip(signed, wanted):
            groups.setdefault(root.get(f, f), set()).add(w)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(wanted))


def test_awkward_rows(spark):
    rows = simhash.near_duplicates(small.awkward(spark)).collect()
    assert len(rows) == 9
    # Null, empty and blank texts share the fingerprint zero.
    assert {r.component_id for r in rows if r.fp == 0} == {1}
    assert {r.component_id for r in rows if r.doc_id in (3, 4)} == {3}
    assert simhash.near_duplicates(small.empty(spark)).count() == 0
    one = simhash.one_of_each(small.awkward(spark))
    assert one.columns == small.awkward(spark).columns
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "3", "5", "None"]
    assert simhash.one_of_each(small.empty(spark)).count() == 0
    assert small.others_kept(small.awkward(spark), one)


def test_near_copies_without_ids_fold(spark):
    words = [f"w{i}" for i in range(3000)]
    near = " ".join([*words[:-1], "other"])
    assert 0 < (simhash.fingerprint_of(" ".join(words)) ^ simhash.fingerprint_of(near)).bit_count() <= 2
    rows = [(None, t, None, None, None) for t in (" ".join(words), near, "quite another text", near)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, small.SCHEMA)).collect()
    assert len(kept) == 2 and {r.text[:2] for r in kept} == {"w0", "qu"}


def test_shingles_and_bits_are_parameters(spark):
    rnd = random.Random(12)
    base = [rnd.getrandbits(63) for _ in range(30)]
    fps = sorted({x ^ d for x in base for d in (0, 1, 3, 7, 1 << 40, (1 << 40) | 2)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bits in (0, 1, 2):
        wanted = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits}
        for key_rows in (1, 1000) if bits < 2 else (1000,):
            assert {(r.a, r.b) for r in simhash.links(frame, key_rows, bits).collect()} == wanted
    rows = {n: small.by_id(simhash.near_duplicates(small.documents(spark, ["a b c d e", "a b c d e f"]), shingle_words=n)) for n in (3, 5)}
    assert rows[5][0].fp != rows[3][0].fp and rows[5][0].fp % 2**64 == simhash.fingerprint_of("a b c d e", 5)


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = queries.op1_simhash_near_dedup(spark, sf_dir).collect()
    texts = sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in texts]
    wanted = {texts[i][0]: (f"{fps[i]:016x}", texts[g][0]) for i, g in enumerate(plain_groups(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == wanted
