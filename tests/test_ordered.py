import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import rangejoin as rj

ROWS = "k string, at long, v long"


def rows(seed):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", None]), rnd.randint(-50, 300), rnd.randint(0, 9)) for _ in range(150)]


@pytest.mark.parametrize("width", [1, 16, 1000])
def test_running_total(spark, width):
    data = rows(1)
    got = rj.running_total(spark.createDataFrame(data, ROWS), ["k"], "at", F.col("v"), "t", width).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.t == sum(v for k, at, v in data if k == r.k and at <= r.at)


@pytest.mark.parametrize("width", [1, 16, 1000])
def test_previous(spark, width):
    data = sorted({(k, at): (k, at, v) for k, at, v in rows(2)}.values(), key=repr)
    got = rj.previous(spark.createDataFrame(data, ROWS), ["k"], "at", "v", "p", width).collect()
    for r in got:
        before = [(at, v) for k, at, v in data if k == r.k and at < r.at]
        assert r.p == (max(before)[1] if before else None)


def test_sessions(spark):
    data = rows(3)
    got = rj.sessions(spark.createDataFrame(data, ROWS), ["k"], "at", 5).collect()
    for r in got:
        places = sorted({at for k, at, _ in data if k == r.k and at <= r.at})
        assert r.session_id == 1 + sum(b - a > 5 for a, b in zip(places, places[1:]))


def test_runs_and_empty_tables(spark):
    got = rj.runs(spark.createDataFrame([("a", x, 0) for x in (1, 2, 3, 7, 8, 20)], ROWS), ["k"], "at").collect()
    assert sorted((r.at, r.run_id) for r in got) == [(1, 1), (2, 1), (3, 1), (7, 2), (8, 2), (20, 3)]
    empty = spark.createDataFrame([], ROWS)
    assert rj.running_total(empty, ["k"], "at", F.col("v"), "t", 4).count() == rj.sessions(empty, ["k"], "at", 5).count() == 0
