"""Targets against plain resharing, quotas and draws against their margins, permutations, reruns."""

import random
import re
from collections import Counter, defaultdict
from math import comb

import pytest
import small
from pyspark.sql import functions as F

from shelfmark.llm import mixing, queries

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def plain_targets(sizes):
    """Targets by resharing what is over until none is above its bound; sizes by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, most = sum(sizes.values()), {s: 3 * sizes[s] for s in sizes}
    target = {s: total * weight[s] / sum(weight.values()) for s in sizes}
    for _ in range(1000):
        over = sum(max(0.0, target[s] - most[s]) for s in sizes)
        if over < 1e-9:
            break
        free = [s for s in sizes if target[s] < most[s]]
        target = {s: min(target[s], most[s]) for s in sizes}
        for s in free:
            target[s] += over * weight[s] / sum(weight[f] for f in free)
    return target


def check(rows, sources):
    """Rows (source, size, taken) against the targets of their sources."""
    sizes = defaultdict(int)
    for source, size, _ in rows:
        sizes[source] += size
    targets = plain_targets(dict(sizes))
    taken = defaultdict(int)
    for source, size, n in rows:
        assert 0 <= n <= 3 * size
        assert n >= size * int(targets[source] / size if False else targets[source] / max(sizes[source], 1) + 1e-9)
        taken[source] += n
    for r in sources:
        assert r.size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert abs(taken[r.source] - targets[r.source]) <= 0.5 + 1e-6


def mixed(spark, rows, **how):
    mix = mixing.Mix(table(spark, rows), "doc_id", **how)
    sources = {r.rank: r for r in mix.sources.collect()}
    found = mix.taken.collect()
    assert sorted(str(r.id) for r in found) == sorted(str(r[0]) for r in rows)
    check([(sources[r["rank"]].source, r.size, r.taken) for r in found], sources.values())
    return mix, sources


def made_up(n, sources, seed=1):
    rnd = random.Random(seed)
    hot = lambda: sources[0] if rnd.random() < 0.4 else rnd.choice(sources)
    return [(i, " ".join(["w"] * int(rnd.expovariate(1 / 60))), hot()) for i in range(n)]


def test_margins_of_the_tree(spark):
    rows = made_up(900, ["b", "a", "é", "\U0001F600", "￿", None, "c c"]) + [(5000, "w " * 20_000, "c c"), (5001, "", "empty"), (5002, None, "none")]
    mix, sources = mixed(spark, rows, block_words=16, shard_blocks=40)
    assert [r.source for _, r in sorted(sources.items())] == ["a", "b", "c c", "empty", "none", "é", "￿", "\U0001F600", None]
    quotas = mix.quotas.collect()
    assert mix.n_shards > 60 and {q.shard for q in quotas} == set(range(mix.n_shards))
    of_shard, of_source = Counter(), defaultdict(list)
    for q in quotas:
        assert q.k > 0
        of_shard[q.shard] += q.k
        of_source[q["rank"]].append((q.first, q.first + q.k))
    assert set(of_shard.values()) <= {mix.n_blocks // mix.n_shards, mix.n_blocks // mix.n_shards + 1}
    for rank, spans in of_source.items():  # intervals lie end to end: draws are disjoint and whole
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == sources[rank].blocks
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    draws = mix.draws.collect()
    assert len(draws) == mix.n_blocks == len({(d["rank"], d["pass"], d.block) for d in draws})
    pieces = mix.pieces.collect()
    assert sum(p.to_word - p.from_word for p in pieces) == sum(d.words for d in draws) == sum(r.words for r in sources.values())


def test_more_sources_than_a_node_holds(spark):
    rows = made_up(1500, [f"s{i:03}" for i in range(90)])
    mix, sources = mixed(spark, rows, block_words=8, shard_blocks=300, fan_out=10)
    assert mix.n_shards > 16
    of_shard, of_source = Counter(), Counter()
    for q in mix.quotas.collect():
        of_shard[q.shard] += q.k
        of_source[q["rank"]] += q.k
    assert set(of_shard.values()) <= {mix.n_blocks // mix.n_shards, mix.n_blocks // mix.n_shards + 1}
    assert dict(of_source) == {r: s.blocks for r, s in sources.items() if s.blocks}
    assert len({(d["rank"], d["pass"], d.block) for d in mix.draws.collect()}) == mix.n_blocks


def test_streams_follow_contents_alone(spark):
    rows = made_up(250, ["a", "b", None], seed=4)
    one, _ = mixed(spark, rows, block_words=16, shard_blocks=16, buckets=40)
    other = mixing.Mix(table(spark, rows[::-1]).repartition(13), "doc_id", block_words=16, shard_blocks=16, buckets=40)
    for name in ("taken", "pieces"):
        assert sorted(map(str, getattr(one, name).collect())) == sorted(map(str, getattr(other, name).collect()))
    placed = one.documents.where("size > 0").collect()
    for rank in {r["rank"] for r in placed}:  # rows of a source lie end to end
        own = sorted((r.first, r.size) for r in placed if r["rank"] == rank)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    third = mixing.Mix(table(spark, rows), "doc_id", seed=9, block_words=16, shard_blocks=16)
    assert sorted(map(str, one.taken.collect())) != sorted(map(str, third.taken.collect()))


def test_draws_are_hypergeometric(spark):
    for total, marked, draws in ((20, 8, 9), (12, 11, 5), (9, 3, 8), (40, 2, 20), (30, 15, 15)):
        n = 20_000
        x = mixing.hypergeometric(*(F.lit(v).cast("bigint") for v in (total, marked, draws)), mixing.uniform(F.lit(3), F.col("id")))
        counts = {r.x: r["count"] for r in spark.range(n).select(x.alias("x")).groupBy("x").count().collect()}
        for k in range(0, draws + 1):
            chance = comb(marked, k) * comb(total - marked, draws - k) / comb(total, draws) if k <= marked and draws - k <= total - marked else 0
            assert abs(counts.get(k, 0) / n - chance) < 0.02 and (chance or k not in counts), (total, marked, draws, k)
    big = mixing.hypergeometric(F.lit(10**10), F.lit(4 * 10**9), F.lit(5 * 10**9), mixing.uniform(F.col("id")))
    rows = [r.x for r in spark.range(4).select(big.alias("x")).collect()]
    assert all(abs(x - 2 * 10**9) < 12 * 50_000 for x in rows) and len(set(rows)) == 4


def test_permutations(spark):
    for n in (1, 2, 7, 64, 1000):
        places = spark.range(n).select(*[mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(k)).alias(f"p{k}") for k in (1, 2)])
        rows = places.collect()
        assert sorted(r.p1 for r in rows) == sorted(r.p2 for r in rows) == list(range(n))
        assert n < 64 or sum(r.p1 == r.p2 for r in rows) < n / 4


def test_order_inside_a_shard_is_mixed(spark):
    mix, _ = mixed(spark, made_up(900, ["a", "b"]), block_words=16, shard_blocks=200)
    draws = sorted((d.order, d["rank"]) for d in mix.draws.where("shard = 0").collect())
    ranks = [r for _, r in draws]
    changes = sum(a != b for a, b in zip(ranks, ranks[1:]))
    assert changes > len(ranks) / 5


def test_one_source_many_equal_rows_and_no_rows(spark):
    mixed(spark, [(1, "a b c", "s")] * 40)
    mixed(spark, [(1, "a b c", None), (None, "a b c d", None), (None, None, None)])
    mixed(spark, [(1, None, "s"), (2, "", None)])
    none = mixing.Mix(small.empty(spark), "doc_id")
    assert none.taken.count() == none.pieces.count() == none.sources.count() == 0
    awkward = small.awkward(spark)
    assert mixing.Mix(awkward, "doc_id", block_words=64, shard_blocks=8).taken.count() == awkward.count()


def test_whole_table_without_python_in_the_plan(spark, capsys):
    result = queries.op11_mixing_sources(spark, SF_DIR)
    rows = result.collect()
    documents = {d.doc_id: d for d in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(documents) and len(rows) == len(documents)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", documents[r.doc_id].text or ""))
    sizes = defaultdict(int)
    for d in documents.values():
        sizes[d.source] += len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    targets = plain_targets(dict(sizes))
    taken = defaultdict(int)
    for r in rows:
        source = documents[r.doc_id].source
        assert r.source_size == sizes[source] and r.target == pytest.approx(targets[source])
        taken[source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in targets)
    result.explain()
    assert "Python" not in capsys.readouterr().out
