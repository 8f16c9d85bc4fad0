"""Joins and pairs with hot keys, components against brute force."""

import random
from itertools import combinations

from veinstone.operators import components, skew


def test_join_hot(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1000)
    big = spark.createDataFrame([("h" if n % 3 else f"k{n}", n) for n in range(300)], "k string, n long")
    small = spark.createDataFrame([("h", 200, "H"), *[(f"k{n}", 1, "C") for n in range(0, 300, 3)], ("unused", 0, "U")], "k string, rows long, v string")
    out = skew.join_hot(big, small, "k", "rows")
    assert sorted((r.k, r.n, r.v) for r in out.collect()) == sorted(("h", n, "H") if n % 3 else (f"k{n}", n, "C") for n in range(300))


def test_pairs_within(spark, monkeypatch):
    monkeypatch.setattr(skew, "BLOCK_ROWS", 7)
    groups = {"a": list(range(40)), "b": [100, 101], "c": [200]}
    rows = spark.createDataFrame([(g, m) for g, ms in groups.items() for m in ms], "g string, m long")
    got = [(r.m_a, r.m_b) for r in skew.pairs_within(rows, "g", "m").collect()]
    assert len(got) == len(set(got)) and set(got) == {p for ms in groups.values() for p in combinations(ms, 2)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(n, n + 1) for n in range(200, 240)] + [(5, 5)]
    parent = {n: n for n in range(250)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(n,) for n in range(250)], "node long")
    got = {r.node: r.component for r in components.connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in range(250)}
    none = components.connected_components(nodes, spark.createDataFrame([], "a long, b long"))
    assert none.where("node <> component").count() == 0 and none.count() == 250
