"""Ranks and components against brute force."""

import random

from pagewright.llm.components import connected_components
from pagewright.llm.ranks import exact_ranks


def test_exact_ranks_equal_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), float(rng.randint(0, 40))) for _ in range(900)] + [("a", 7.0)] * 700 + [(None, 1.0), ("a", None)]
    got = exact_ranks(spark.createDataFrame(data, "g string, v double").repartition(7), ["g"], "v").collect()
    clean = [(g, v) for g, v in data if g is not None and v is not None]
    assert len(got) == len(set(clean))
    for r in got:
        assert r["n"] == clean.count((r["g"], r["v"]))
        assert r["below"] == sum(g == r["g"] and v < r["v"] for g, v in clean)
        assert r["total"] == sum(g == r["g"] for g, _ in clean)


def test_exact_ranks_of_nothing(spark):
    assert exact_ranks(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(0, i) for i in range(200, 260)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in list(parent)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in want.items()}


def test_components_of_self_links(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0
