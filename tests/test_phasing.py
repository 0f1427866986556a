"""Local search and gains against brute force over all haplotypes of small blocks."""

import itertools
import math
import random

import pytest

from strandweave.operators import fragments as fg
from strandweave.operators import linkage

CALLS = "frag_id string, varid long, allele int, qv int"


def likelihood(frags, hap):
    total = 0.0
    for calls in frags.values():
        sides = []
        for flip in (0, 1):
            x = 0.0
            for v, a, q in calls:
                e = 10 ** (-q / 10)
                x += math.log10(1 - e if a == hap[v] ^ flip else e)
            sides.append(x)
        top = max(sides)
        total += top + math.log10(sum(10 ** (s - top) for s in sides))
    return total


@pytest.fixture(scope="module")
def small():
    rnd = random.Random(12)
    blocks, frags = {}, {}
    for b in range(6):
        ids = [b * 100 + i * 3 + 1 for i in range(7)]
        true = {v: rnd.randint(0, 1) for v in ids}
        blocks[ids[0]] = ids
        for f in range(9):
            lo = rnd.randrange(5)
            side = rnd.randint(0, 1)
            frags[f"b{b}f{f}"] = [(v, true[v] ^ side ^ (rnd.random() < 0.2), rnd.choice((8, 15, 30))) for v in ids[lo : lo + rnd.randint(2, 4)]]
        frags[f"b{b}all"] = [(v, true[v], 9) for v in ids]
    return blocks, frags


def test_refined_phases_are_as_likely_as_the_best(spark, small):
    blocks, frags = small
    calls = spark.createDataFrame([(f, *c) for f, cs in frags.items() for c in cs], CALLS)
    start = spark.createDataFrame([(v, b, i % 2) for b, ids in blocks.items() for i, v in enumerate(ids)], "varid long, block_id long, hap int")
    rows = fg.refine(calls, start).collect()
    hap = {r.varid: r.hap for r in rows}
    reached = 0
    for b, ids in blocks.items():
        own = {f: cs for f, cs in frags.items() if cs[0][0] in ids}
        got = likelihood(own, hap)
        every = {h: likelihood(own, dict(zip(ids, h))) for h in itertools.product((0, 1), repeat=len(ids))}
        now = tuple(hap[v] for v in ids)
        for i in range(len(ids)):  # no single flip and no switch is better
            assert every[tuple(x ^ (j == i) for j, x in enumerate(now))] <= got + 1e-5
            assert every[tuple(x ^ (j >= i) for j, x in enumerate(now))] <= got + 1e-5
        reached += got >= max(every.values()) - 1e-6
    assert reached >= 5
    for r in rows:  # the posterior against its definition
        own = {f: cs for f, cs in frags.items() if any(c[0] == r.varid for c in cs)}
        one, two = likelihood(own, hap), likelihood(own, hap | {r.varid: 1 - r.hap})
        assert r.posterior == pytest.approx(1 / (1 + 10 ** (two - one)), abs=1e-9)


def test_gains_of_switches(spark, small):
    blocks, frags = small
    calls = spark.createDataFrame([(f, *c) for f, cs in frags.items() for c in cs], CALLS)
    hap = {v: v % 2 for ids in blocks.values() for v in ids}
    frame = spark.createDataFrame([(v, b, hap[v]) for b, ids in blocks.items() for v in ids], "varid long, block_id long, hap int")
    for r in fg.switch_gains(calls, frame).collect():
        cut = hap | {v: 1 - hap[v] for v in blocks[r.block_id] if v >= r.varid}
        assert r.gain == pytest.approx(likelihood(frags, cut) - likelihood(frags, hap), abs=1e-6)


def test_rounds_go_on_until_nothing_flips(spark):
    calls = spark.createDataFrame([(f"f{i}", i + j, 0, 30) for i in range(1, 60) for j in (0, 1)], CALLS)
    blocks = spark.createDataFrame([(i, 1) for i in range(1, 61)], "varid long, block_id long")
    rows = fg.phase(calls, blocks).collect()
    assert {r.hap for r in rows} == {0} and {r.confidence for r in rows} == {1.0}
    assert fg.refine(calls, fg.phase(calls, blocks)).filter("posterior < 0.9").count() == 0


def test_long_fragments_do_not_underflow(spark):
    rows = [("f", 6000, s, v + 1000 * s, v % 2, 60) for s in (False, True) for v in range(400)]
    calls = spark.createDataFrame(rows, "frag_id string, isize int, second boolean, varid long, allele int, qv int")
    hap = spark.createDataFrame([(v + 1000 * s, 0) for s in (0, 1) for v in range(400)], "varid long, hap int")
    (r,) = linkage.trans_rates(calls, hap).collect()
    assert (r.bin, r.n) == (1, 1) and 0 < r.rate < 1


def test_empty(spark):
    calls = spark.createDataFrame([], CALLS)
    hap = spark.createDataFrame([], "varid long, block_id long, hap int")
    assert fg.refine(calls, hap).count() == fg.switch_gains(calls, hap).count() == fg.half_length(hap, "varid").filter("n50 > 0").count() == 0
