"""Layers against a plain walk over the references, chains, cycles and bounded rounds."""

import random

from pyspark.sql import functions as F

from shelfmark.operators import load_order


def run(spark, keys, references):
    records = spark.createDataFrame([(k,) for k in keys], "key string")
    refs = spark.createDataFrame(references, "key string, target string, optional boolean")
    return {r.key: (r.layer, r.deferred, r.state) for r in load_order.load_layers(records, refs).collect()}


def reachable(keys, edges):
    out = {k: set() for k in keys}
    for k in keys:
        todo = [k]
        while todo:
            for t in edges.get(todo.pop(), ()):
                if t not in out[k]:
                    out[k].add(t)
                    todo.append(t)
    return out


def plain(keys, references):
    """By transitive closure: layers of what no cycle holds up; optional references in cycles are put off."""
    keys = {k for k in keys if k is not None}
    edges, optional = {k: set() for k in keys}, {}
    for k, t, o in references:
        if k in keys and t in keys:
            edges[k].add(t)
            optional[k, t] = optional.get((k, t), True) and o
    deferred = dict.fromkeys(keys, 0)
    while True:
        reach = reachable(keys, edges)
        looped = {k for k in keys if k in reach[k]}
        held = {k for k in keys if k in looped or reach[k] & looped}
        core = {k for k in held if k in looped or any(k in reach[c] for c in looped)}
        off = [(k, t) for k in core for t in edges[k] if t in core and optional[k, t]]
        if not off:
            break
        for k, t in off:
            edges[k].discard(t)
            deferred[k] += 1
    layer = {}

    def of(k):
        if k not in layer:
            layer[k] = max((1 + of(t) for t in edges[k]), default=0)
        return layer[k]

    return {k: (None if k in held else of(k), deferred[k], "cycle" if k in core else "held" if k in held else "ready") for k in keys}


def test_small_graphs(spark):
    cases = [
        ([], []),
        (["a", "a", None], [("a", None, True), ("a", "gone", False), (None, "a", False)]),
        (["a"], [("a", "a", False)]),
        (["a", "b"], [("a", "a", True), ("b", "a", False)]),
        ("abcde", [("a", "b", False), ("b", "c", False), ("c", "a", False), ("d", "a", False), ("c", "e", False)]),
        ("abcde", [("a", "b", False), ("b", "a", True), ("c", "b", True), ("d", "c", False), ("a", "e", False)]),
        ("abcd", [("a", "b", False), ("b", "a", False), ("a", "c", True), ("c", "d", False), ("d", "c", False)]),
        ("abcd", [("a", "b", False), ("a", "c", False), ("b", "d", False), ("c", "b", False)]),
    ]
    for keys, references in cases:
        assert run(spark, keys, references) == plain(keys, references), references


def test_random_graphs(spark):
    rnd = random.Random(2)
    for links in (20, 34):
        keys = [f"k{i}" for i in range(28)]
        references = [(rnd.choice(keys), rnd.choice(keys[: rnd.randint(1, 28)]), rnd.random() < 0.4) for _ in range(links)]
        assert run(spark, keys, references) == plain(keys, references), references


def test_a_long_chain_takes_few_rounds(spark):
    n = 1000
    keys = spark.range(n).selectExpr("CAST(id AS string) AS key")
    edges = spark.range(1, n).selectExpr("CAST(id AS string) AS key", "CAST(id - 1 AS string) AS target")
    layers, rounds = load_order._layers(keys, edges)
    assert rounds <= 12 and all(r.layer == int(r.key) for r in layers.collect())


def test_a_hot_record_and_a_cycle_at_the_end_of_a_chain(spark):
    chain = [(f"c{i}", f"c{i - 1}", False) for i in range(1, 40)] + [("c0", "c1", False)]
    crowd = [(f"x{i}", "root", False) for i in range(500)]
    keys = ["root", *(f"c{i}" for i in range(40)), *(f"x{i}" for i in range(500))]
    found = run(spark, keys, chain + crowd)
    assert {found[f"x{i}"] for i in range(500)} == {(1, 0, "ready")}
    assert [found[f"c{i}"][2] for i in range(40)] == ["cycle"] * 2 + ["held"] * 38


def families():
    """A short tree above records with an optional reference to the end of a chain that begins at them."""
    references = [(f"m{i}", "root", False) for i in range(3)] + [(f"l{i}", f"m{i % 3}", False) for i in range(9)]
    for i in range(60):
        orders = [f"o{i}-{j}" for j in range(i % 6)]
        references += [(f"k{i}", f"l{i % 9}", False), *((o, f"k{i}", False) for o in orders)]
        references += [(o, earlier, False) for earlier, o in zip(orders, orders[1:])]
        references += [(f"k{i}", o, True) for o in orders[-1:]]
    return sorted({k for k, _, _ in references} | {"root"}), references


def test_following_few_records_or_all(spark, monkeypatch):
    keys, references = families()
    wanted = plain(keys, references)
    for few in (1, 20, 10**9):
        monkeypatch.setattr(load_order, "FEW", few)
        assert run(spark, keys, references) == wanted, few


def test_rounds_write_numbers_and_little_while_few_records_are_found(spark, monkeypatch):
    written, stored = [], load_order._stored

    def watched(df, label):
        out = stored(df, label)
        written.append((label, dict(out.dtypes), out.count()))
        return out

    monkeypatch.setattr(load_order, "_stored", watched)
    # A small tree and a large cycle beside it.
    tree = [(f"a{i}", "root", False) for i in range(2)] + [(f"b{i}", f"a{i % 2}", False) for i in range(8)]
    cycle = [(f"c{i}", f"c{(i + 1) % 5000}", False) for i in range(5000)]
    keys = [*{k for k, _, _ in tree + cycle}, "root"]
    found = run(spark, keys, tree + cycle)
    assert found["b7"] == (2, 0, "ready") and found["c9"] == (None, 0, "cycle")
    assert all(types.get("key", "bigint") == "bigint" and types.get("target", "bigint") == "bigint" for label, types, _ in written if label != "keys")
    # Once for the cycle's records in each direction; before, each round wrote all open references twice.
    assert sum(rows for label, _, rows in written if label in ("layers", "open-references", "met-references")) < 4 * 5000


def test_keys_of_one_hash_are_kept_apart(spark, monkeypatch):
    keys, references = families()
    keys, references = keys[:40], [*references, ("k1", "gone", False), ("gone", "k1", False)]
    used, hashed = [], load_order._hash

    def colliding(key, seed):
        used.append(seed)
        return hashed(key, seed) % 7 if seed < 2 else hashed(key, seed)

    monkeypatch.setattr(load_order, "_hash", colliding)
    assert run(spark, keys, references) == plain(keys, references)
    assert max(used) == 2


def test_steps_on_cycles_stay_numbers(spark):
    end = F.lit(load_order.ENDLESS)
    row = spark.range(1).select(load_order._sum(end, end).alias("a"), load_order._sum(F.lit(2), F.lit(3)).alias("b"), load_order._sum(F.lit(None).cast("bigint"), end).alias("c"))
    assert tuple(row.first()) == (load_order.ENDLESS, 5, None)
