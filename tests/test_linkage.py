import random

import pytest

from strandweave.operators import linkage


def test_pileup(spark):
    df = spark.createDataFrame([("c", 5, "ACG"), ("c", 6, "ct"), ("d", 1, "N")], "chrom string, s long, bases string")
    got = sorted(tuple(r) for r in linkage.pileup(df).collect())
    assert got == [("c", 6, 2, 0, 2, 0, 0), ("c", 7, 2, 0, 0, 1, 1)]


def test_linkage(spark):
    rows = [(f"f{i}", v, a, 30) for i, (x, y) in enumerate([(0, 0), (1, 1), (0, 0), (1, 1)]) for v, a in ((1, x), (2, y), (3, 0))]
    got = {(r.a, r.b): (r.n, r.r2) for r in linkage.linkage(spark.createDataFrame(rows, "frag_id string, varid long, allele int, qv int")).collect()}
    assert got == {(1, 2): (4, pytest.approx(1.0)), (2, 3): (4, None)}


def test_planted_trans_rate(spark):
    rnd = random.Random(6)
    rows = []
    for f in range(1500):
        side, trans = rnd.randint(0, 1), rnd.random() < 0.25
        rows += [(f"f{f}", 7000, False, v, side, 30) for v in (1, 2)] + [(f"f{f}", 7000, True, v, side ^ trans, 30) for v in (8, 9)]
    calls = spark.createDataFrame(rows, "frag_id string, isize int, second boolean, varid long, allele int, qv int")
    hap = spark.createDataFrame([(v, 0) for v in (1, 2, 8, 9)], "varid long, hap int")
    (r,) = linkage.trans_rates(calls, hap).collect()
    assert (r.bin, r.n) == (1, 1500) and r.rate == pytest.approx(0.25, abs=0.03)


def test_empty(spark):
    calls = spark.createDataFrame([], "frag_id string, isize int, second boolean, varid long, allele int, qv int")
    assert linkage.trans_rates(calls, spark.createDataFrame([], "varid long, hap int")).count() == 0
    assert linkage.linkage(calls).count() == 0


def test_a_whole_pileup_is_registered(spark, sf_dir):
    from strandweave.plans import catalogue

    depths = {r.depth for r in catalogue.QUERIES["pileup_all"](spark, sf_dir).select("depth").distinct().collect()}
    assert {1, 2} <= depths and "asm_regions_strict" in catalogue.QUERIES
