import math
import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import association as a


def fisher(x):
    (p, q, r, s) = x
    m, n, k = p + r, q + s, p + q
    lp = lambda i: math.lgamma(m + 1) + math.lgamma(n + 1) + math.lgamma(k + 1) + math.lgamma(m + n - k + 1) - math.lgamma(m + n + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) - math.lgamma(k - i + 1) - math.lgamma(n - k + i + 1)
    return min(1, sum(math.exp(lp(i)) for i in range(max(0, k - n), min(k, m) + 1) if lp(i) <= lp(p) + 1e-7))


KNOWN = [((4, 0, 0, 22), 0.000067), ((4, 0, 3, 19), 0.002341), ((7, 0, 0, 17), 0.000003), ((5, 2, 0, 17), 0.000494)]


def test_fisher(spark):
    rnd = random.Random(1)
    tables = [t for t, _ in KNOWN] + [tuple(rnd.choice([0, 1, 3, 40, 300]) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, mm long, mu long, um long, uu long")
    got = {r.i: r.p for r in df.select("i", a.fisher_exact(*[F.col(c) for c in ("mm", "mu", "um", "uu")]).alias("p")).collect()}
    for i, t in enumerate(tables):
        assert got[i] == pytest.approx(fisher(t), abs=1e-9)
    for i, (_, p) in enumerate(KNOWN):
        assert round(got[i], 6) == p


def test_adjusted_p_with_ties(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.9, 0.04, 0.02]
    got = {r.i: r.q for r in a.adjust_p(spark.createDataFrame(list(enumerate(p)), "i int, p double")).collect()}
    order = sorted(range(len(p)), key=lambda i: p[i])
    want, least = {}, 1.0
    for rank in range(len(p), 0, -1):
        i = order[rank - 1]
        least = min(least, p[i] * len(p) / rank)
        want[i] = least
    for v in set(p):  # ties get the value of their last rank
        same = [i for i in want if p[i] == v]
        for i in same:
            assert got[i] == pytest.approx(min(want[j] for j in same))


def test_regions_break_where_a_pair_is_filtered(spark):
    pairs = [("c", "+", 10 * i, 10 * i + 10, 5, 0, 0, 9, 0.5 if i == 3 else 0.001) for i in range(8)]
    df = spark.createDataFrame(pairs, "chrom string, strand string, c1 long, c2 long, mm long, mu long, um long, uu long, p double")
    got = a.allele_specific_regions(df).orderBy("start_pos").collect()
    assert [(r.start_pos, r.end_pos, r.label, r.n_sites) for r in got] == [(0, 30, "Meth:30", 4), (40, 80, "Meth:40", 5)]


@pytest.mark.parametrize("width", [4, 1 << 18])
def test_next_pairs_over_bins(spark, width):
    df = spark.createDataFrame([("c", "+", p) for p in (1, 3, 3, 17, 90)] + [("c", "-", 2)], "chrom string, strand string, pos int")
    got = sorted((r.c1, r.c2) for r in a.next_site_pairs(df, width).collect())
    assert got == [(1, 3), (3, 17), (17, 90)]


@pytest.mark.parametrize("bucket", [3, 1 << 18])
def test_adjusted_p_of_small_values(spark, bucket):
    rnd = random.Random(9)
    p = [1e-9, 3e-8, 4e-7, 4e-7, 4.4e-7] + [rnd.choice([0.3, 0.5, 1.0, 10 ** -rnd.uniform(0, 9)]) for _ in range(60)]
    rows = a.adjust_p(spark.createDataFrame(list(enumerate(p)), "i int, p double"), bucket=bucket).collect()
    assert {r.i: r.p for r in rows} == dict(enumerate(p))
    for r in rows:
        assert r.q == pytest.approx(min(1.0, *[x * len(p) / sum(y <= x for y in p) for x in p if x >= r.p]), rel=1e-12)


def test_equal_tables_are_adjusted_as_many(spark):
    rnd = random.Random(3)
    rows = [("c", "+", i, i + 1, *(rnd.choice([0, 1, 2, 9]) for _ in range(4))) for i in range(80)]
    df = spark.createDataFrame(rows, "chrom string, strand string, c1 long, c2 long, mm long, mu long, um long, uu long")
    one = {r.c1: (r.p, r.q) for r in a.test_pairs(df).collect()}
    p = df.withColumn("p", a.fisher_exact(*[F.col(c) for c in ("mm", "mu", "um", "uu")]))
    two = {r.c1: (r.p, r.q) for r in a.adjust_p(p).collect()}
    assert len(one) == 80 and all(one[k] == pytest.approx(two[k]) for k in two)
    assert a.test_pairs(df.limit(0)).count() == 0
