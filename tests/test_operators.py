import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import reads as fr
from strandweave.operators import annotate, fragments as fg, merge, rangejoin, sites


def test_flags(spark):
    df = spark.createDataFrame([(f,) for f in (99, 147, 83, 163, 0, 16)], "f int")
    got = [tuple(r) for r in df.select("f", fr.strand(F.col("f")), fr.hit_type(F.col("f"))).collect()]
    assert got == [(99, "+", 1), (147, "+", 3), (83, "-", 4), (163, "-", 2), (0, "+", 1), (16, "-", 4)]


def test_cigar(spark):
    r = spark.createDataFrame([("5S10M2I3M4D6M",)], "c string").select(fr.reference_length(F.col("c")).alias("n"), fr.aligned_blocks(F.col("c")).alias("b")).first()
    assert r.n == 23
    assert [tuple(x) for x in r.b] == [(5, 0, 10), (17, 10, 3), (20, 17, 6)]


def test_filters_differ(spark):
    df = spark.createDataFrame([(2, 10), (5, 10), (9, 10), (3, 5)], "mc int, cov int")
    assert sites.heterozygous(df).count() == 1
    assert sites.heterozygous(df, both_alleles=False).count() == 3


def test_bin_join_against_brute_force(spark):
    rnd = random.Random(3)
    points = [(rnd.choice("ab"), rnd.randint(0, 300)) for _ in range(60)]
    spans = [(rnd.choice("ab"), s, s + rnd.choice([-1, 0, 5, 120])) for s in (rnd.randint(0, 300) for _ in range(60))]
    p, i = spark.createDataFrame(points, "k string, pos int"), spark.createDataFrame(spans, "k string, s int, e int")
    got = sorted((r.k, r.pos, r.s, r.e) for r in rangejoin.bin_join(p, i, ["k"], "pos", "s", "e", 16).collect())
    assert got == sorted((k, x, s, e) for k, x in points for k2, s, e in spans if k == k2 and s <= x <= e)


@pytest.mark.parametrize("width", [8, 1 << 18])
def test_depth(spark, width):
    spans = [("a", 1, 4), ("a", 3, 20), ("a", 3, 3), ("b", 7, 7)]
    df = spark.createDataFrame(spans, "k string, s int, e int")
    got = {}
    for r in rangejoin.depth_runs(df, ["k"], "s", "e", width).collect():
        for x in range(r.start_pos, r.end_pos + 1):
            got[r.k, x] = r.depth
    want = {(k, x): sum(k2 == k and s <= x <= e for k2, s, e in spans) for k in "ab" for x in range(30)}
    assert got == {k: v for k, v in want.items() if v}


def planted(rnd, n=40, reads=400, error=0.0):
    truth = [rnd.randint(0, 1) for _ in range(n)]
    rows = []
    for f in range(reads):
        s, flip = rnd.randint(0, n - 4), rnd.randint(0, 1)
        rows += [(f"f{f}", v + 1, truth[v] ^ flip ^ (rnd.random() < error), 30) for v in range(s, s + 4)]
    return truth, rows


CALLS = "frag_id string, varid long, allele int, qv int"


@pytest.mark.parametrize("error", [0.0, 0.05])
def test_phasing_finds_planted_haplotypes(spark, error):
    truth, rows = planted(random.Random(5), error=error)
    calls = spark.createDataFrame(rows, CALLS)
    blocks = fg.spanning_blocks(calls, chunk=8)
    assert {r.block_id for r in blocks.collect()} == {1}
    hap = {r.varid: r.hap for r in fg.phase(calls, blocks).collect()}
    same = sum(hap[i + 1] == t for i, t in enumerate(truth))
    assert same in (0, len(truth))


def test_blocks_edges_and_runs(spark):
    rows = [("a", 1, 0, 30), ("a", 2, 1, 40), ("b", 2, 0, 10), ("b", 5, 0, 10), ("c", 7, 1, 9), ("d", 8, 1, 9), ("d", 9, 1, 9)]
    calls = spark.createDataFrame(rows, CALLS)
    for chunk in (1, 3, 1000):
        assert {r.varid: r.block_id for r in fg.spanning_blocks(calls, chunk).collect()} == {1: 1, 2: 1, 5: 1, 8: 8, 9: 8}
    assert sorted(tuple(r) for r in fg.path_edges(calls).collect()) == [(1, 2, 0, 1), (2, 5, 1, 0), (8, 9, 1, 0)]
    got = {r.frag_id: (r.n_blocks, r.runs, r.quals) for r in fg.fragment_runs(calls).collect()}
    assert got["a"] == (1, "1 01", "?I") and got["b"] == (2, "2 0 5 0", "++")


def test_likelihood_does_not_change_under_complement(spark):
    _, rows = planted(random.Random(9), n=10, reads=30, error=0.1)
    calls = spark.createDataFrame(rows, CALLS)
    one = spark.createDataFrame([(v, v % 2) for v in range(1, 11)], "varid long, hap int")
    two = one.select("varid", (1 - F.col("hap")).alias("hap"))
    a, b = ({r.frag_id: r.ll for r in fg.log_likelihood(calls, h).collect()} for h in (one, two))
    assert a == pytest.approx(b)


def test_switches_and_mismatches(spark):
    truth = spark.createDataFrame([(v, 0) for v in range(1, 11)], "varid long, true_hap int")
    cases = {1: ([0] * 10, 0, 0), 2: ([0] * 5 + [1] * 5, 1, 0), 3: ([0, 0, 0, 1, 0, 0, 0, 0, 0, 0], 0, 1), 4: ([0] * 9 + [1], 0, 1)}
    for block, (haps, switches, mismatches) in cases.items():
        hap = spark.createDataFrame([(v + 1, block, h) for v, h in enumerate(haps)], "varid long, block_id long, hap int")
        r = fg.switch_errors(hap, truth).first()
        assert (r.compared, r.switches, r.mismatches) == (10, switches, mismatches)


def test_half_length(spark):
    df = spark.createDataFrame([(x,) for x in (10, 7, 7, 3, 1)], "span int")
    assert fg.half_length(df, "span").first().n50 == 7


LINKS = "block_id long, chrom string, pos int, hap1 string, hap2 string, source int"


def test_strand_merge_flips_by_votes(spark):
    plus = [(1, "c", 100, "C", "T", 1), (1, "c", 200, "T", "C", 1), (1, "c", 300, "A", "C", 1)]
    minus = [(2, "c", 101, "A", "G", 2), (2, "c", 201, "G", "A", 2), (3, "c", 900, "G", "A", 2)]
    df = spark.createDataFrame(plus + minus, LINKS)
    assert [tuple(r) for r in merge.strand_votes(df).collect()] == [(1, 2, -4, 2)]
    got = {(r.block_id, r.pos): (r.hap1, r.hap2) for r in merge.merge_strands(df).collect()}
    assert got[1, 101] == ("G", "A") and got[1, 201] == ("A", "G") and got[3, 900] == ("G", "A")
    again = merge.merge_strands(merge.merge_strands(df))
    assert {(r.block_id, r.pos): (r.hap1, r.hap2) for r in again.collect()} == got


def test_tied_votes_merge_nothing(spark):
    rows = [(1, "c", 100, "C", "T", 1), (1, "c", 200, "C", "T", 1), (2, "c", 101, "G", "A", 2), (2, "c", 201, "A", "G", 2)]
    assert {r.block_id for r in merge.merge_strands(spark.createDataFrame(rows, LINKS)).collect()} == {1, 2}


def test_profile_reverses_minus_regions(spark):
    regions = spark.createDataFrame([("p", "c", 5000, 5399, "+"), ("m", "c", 5000, 5399, "-")], "region_id string, chrom string, start_pos long, end_pos long, strand string")
    points = spark.createDataFrame([("c", 5000), ("c", 4999)], "chrom string, pos long")
    got = {(r.region_id, r.part, r.bin) for r in annotate.site_bins(regions, points).collect()}
    assert got == {("p", "body", 0), ("m", "body", 39), ("p", "up", 39), ("m", "down", 0)}
    assert annotate.profile(annotate.site_bins(regions, points)).count() == 117


def test_clique_edges_of_long_fragments(spark):
    long = [("f", 3 * v, v % 3 % 2, 30) for v in range(200)]
    short = [("g", v, 1, 30) for v in (0, 3, 9)]
    want = {}
    for c in (long, short):
        for i, x in enumerate(c):
            for y in c[i + 1 :]:
                n = want.setdefault((x[1], y[1]), [0, 0])
                n[x[2] != y[2]] += 1
    df = spark.createDataFrame(long + short, "frag_id string, varid long, allele int, qv int")
    got = fg.clique_edges(df).collect()
    assert len(got) == len(want) == 200 * 199 // 2
    assert {(r.a, r.b): [r.same, r.other] for r in got} == want
