import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import quantiles as q

VALUES = "g string, leaf int, node string, cnt string"


def ranks(values, x):
    return sum(v < x for v in values), sum(v <= x for v in values)


@pytest.mark.parametrize("error", [0.005, 0.05, 0.2])
def test_rank_error_is_bounded_after_merging(spark, error):
    rnd = random.Random(11)
    rows = [("a", int(rnd.lognormvariate(6, 2)) % (1 << 20)) for _ in range(6000)] + [("b", rnd.randint(0, (1 << 20) - 1)) for _ in range(6000)] + [("c", 77)] * 500
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VALUES).repartition(6)
    parts = q.partial_digests(df, ["g"], "leaf", error)
    merged = q.merge_digests(parts, ["g"])
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for digest in (merged, q.merge_digests(q.recompress(merged, ["g"], error), ["g"])):
        twice = 1 if digest is merged else 2
        for r in q.digest_percentiles(digest, ["g"], points).collect():
            values = [v for g, v in rows if g == r.g]
            assert r.n == len(values)
            lo, hi = ranks(values, r.leaf)
            rank, slack = max(1, math.ceil(r.point * r.n)), twice * error * r.n
            assert lo - slack <= rank <= hi + slack


def test_digest_size_is_bounded():
    rnd = np.random.default_rng(2)
    n, k = 200_000, 400
    node = rnd.integers(0, 1 << q.LEVELS, n) + (1 << q.LEVELS)
    g, nodes, cnt = q.compress_nodes(np.zeros(n, np.int64), node, np.ones(n, np.int64), k)
    assert cnt.sum() == n and len(nodes) <= 3 * k + q.LEVELS and len(set(nodes)) == len(nodes)


def test_few_rows_are_exact(spark):
    df = spark.createDataFrame([("a", v, "", "") for v in (5, 1, 9, 9, 2)] + [("b", 4, "", ""), (None, 3, "", ""), ("a", None, "", "")], VALUES)
    d = q.merge_digests(q.partial_digests(df, ["g"], "leaf"), ["g"])
    got = {(r.g, r.point): r.leaf for r in q.digest_percentiles(d, ["g"], [0.5, 1.0]).collect()}
    assert got == {("a", 0.5): 5, ("a", 1.0): 9, ("b", 0.5): 4, ("b", 1.0): 4}


def test_empty(spark):
    d = q.partial_digests(spark.createDataFrame([], VALUES), ["g"], "leaf")
    assert q.digest_percentiles(q.merge_digests(d, ["g"]), ["g"], [0.5]).count() == 0


def test_quantizing(spark):
    counts = [0, 1, 32767, 32768, 32769, 65535, 65536, 10**6, 2**31 - 1]
    df = spark.createDataFrame([(c,) for c in counts], "c int").withColumn("q", q.quantize_count(F.col("c"))).withColumn("back", q.count_of(F.col("q")))
    rows = df.orderBy("c").collect()
    assert [r.q for r in rows] == sorted(r.q for r in rows) and rows[-1].q < 1 << q.LEVELS
    for r in rows:
        assert r.back <= r.c and (r.c - r.back) <= r.c / (1 << (q.EXACT_BITS - 1))
        assert r.c >= 1 << q.EXACT_BITS or r.back == r.c
    levels = spark.createDataFrame([(x,) for x in (0.0, 0.123456, 1.0)], "x double")
    assert [r[0] for r in levels.select(q.unit_of(q.quantize_unit(F.col("x")))).collect()] == [0.0, 0.123456, 1.0]
