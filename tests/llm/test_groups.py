import random

import pytest
from pyspark.sql import functions as F

from strandweave.llm import groups


def brute(edges):
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    return sorted((find(x), x) for x in par)


def shuffled(n, rnd):
    ids = list(range(1, n + 1))
    rnd.shuffle(ids)
    return ids


def shapes():
    rnd = random.Random(4)
    path, cycle, star = shuffled(150, rnd), [1000 + i for i in shuffled(40, rnd)], [2000 + i for i in shuffled(60, rnd)]
    edges = list(zip(path, path[1:]))
    edges += list(zip(cycle, cycle[1:] + cycle[:1]))
    edges += [(star[0], x) for x in star[1:]]
    tree = [3000 + i for i in shuffled(120, rnd)]
    edges += [(tree[i], tree[rnd.randrange(i)]) for i in range(1, 120)]
    core = [4000 + i for i in range(30)]
    edges += [(rnd.choice(core), rnd.choice(core)) for _ in range(90)]
    edges += [(4001, 5000), (5000, 5001), (5001, 4005), (5001, 5002)]  # a chain between core vertices, with a leaf
    edges += [(6000, 6001), (6001, 6002), (6002, 6000), (6002, 6003)]  # a cycle with a tail
    edges += [(7000, 7001), (7001, 7000), (7000, 7001), (7002, 7002), (None, 7000), (7001, None)]
    edges += [(8000 + i, 8000 + j) for i in range(6) for j in range(i)]
    return edges


@pytest.mark.parametrize("keep,core", [(0.7, 0.2), (0.95, 0.0), (0.0, 0.2)])
def test_all_shapes(spark, keep, core):
    edges = shapes()
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "a long, b long, group_id string")
    got = sorted(tuple(r) for r in groups.connected_groups(df, keep=keep, core=core).collect())
    assert got == brute(edges)


def test_random_graphs(spark):
    rnd = random.Random(8)
    edges = [(rnd.randint(1, 300), rnd.randint(1, 300)) for _ in range(260)]
    got = sorted(tuple(r) for r in groups.connected_groups(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == brute(edges)


def test_empty(spark):
    assert groups.connected_groups(spark.createDataFrame([], "a long, b long")).count() == 0
    assert groups.connected_groups(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.fixture
def hot(monkeypatch):
    """Shares so small that hubs are heavy on test data."""
    monkeypatch.setattr(groups, "LIGHT", 3)
    monkeypatch.setattr(groups, "HEAVY", 20)


def test_heavy_hubs(spark, hot):
    edges = shapes() + [(9000, 9000 + i) for i in range(1, 200)] + [(9300 + i, 9301 + i) for i in range(40)] + [(9010, 9300)]
    got = sorted(tuple(r) for r in groups.connected_groups(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == brute(edges)


def test_large_ids(spark):
    top = 9_223_372_036_854_775_000
    edges = [(top + i, top + i + 1) for i in range(40)] + [(-top, -top + 7), (-top + 7, -top + 9), (-top + 9, -top)]
    got = sorted(tuple(r) for r in groups.connected_groups(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == brute(edges)


@pytest.mark.parametrize("light", [1, 10_000])
def test_member_edges_connect_each_group_once(spark, monkeypatch, light):
    monkeypatch.setattr(groups, "LIGHT", light)
    monkeypatch.setattr(groups, "HEAVY", 4)
    rows = [("g", v) for v in (9, 1, 4, 4, 100, 7, 1 << 62)] + [("h", 5), ("i", 2), ("i", 3), (None, 8), (None, 9), ("i", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    edges = [tuple(r) for r in groups.member_edges(df, F.col("g"), F.col("v")).collect()]
    assert len(edges) == 6 and all(a < b for a, b in edges)
    assert brute(edges) == [(1, 1), (1, 4), (1, 7), (1, 9), (1, 100), (1, 1 << 62), (2, 2), (2, 3)]


def test_no_tables_are_left_but_those_of_the_result(spark):
    import os

    from strandweave.session import checkpoint_dir

    tables = lambda: {x for x in os.listdir(checkpoint_dir(spark)) if x.startswith("cut-")}
    before = tables()
    groups.connected_groups(spark.createDataFrame(shapes(), "a long, b long"), keep=0.9).count()
    assert len(tables() - before) <= 2  # members and their groups
