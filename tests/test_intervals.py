import random

import pytest

from strandweave.operators import intervals

SCHEMA = "lib string, chrom string, position int, span int, _start string, kind string"


def brute(rows):
    out = []
    keys = {(r[0], r[1]) for r in rows}
    for k in keys:
        iv = sorted((r[2], r[2] + r[3] - 1) for r in rows if (r[0], r[1]) == k and r[2] and r[3] and r[2] > 0 and r[3] > 0)
        cur = None
        for s, e in iv:
            if cur and s <= cur[1] + 1:
                cur[1] = max(cur[1], e)
                continue
            if cur:
                out += [(*k, "period", *cur), (*k, "gap", cur[1] + 1, s - 1)]
            cur = [s, e]
        if cur:
            out.append((*k, "period", *cur))
    return sorted(out, key=repr)


def run(spark, rows, width):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = intervals.periods_and_gaps(df, ["lib", "chrom"], "position", "span", width).collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("width", [8, 50, 1 << 18])
def test_against_brute_force(spark, width):
    rnd = random.Random(width)
    rows = [(rnd.choice(["a", None]), rnd.choice("xy"), rnd.randint(1, 400), rnd.choice([1, 2, 5, 90])) for _ in range(120)]
    assert run(spark, rows, width) == brute(rows)


def test_touching_nested_repeated_and_dirty_rows(spark):
    rows = [("a", "x", 1, 5), ("a", "x", 6, 5), ("a", "x", 2, 2), ("a", "x", 2, 2), ("a", "x", 12, 1), ("a", "x", None, 3), ("a", "x", 3, None), ("a", "x", -4, 9), ("a", "x", 30, 0)]
    want = [("a", "x", "gap", 11, 11), ("a", "x", "period", 1, 10), ("a", "x", "period", 12, 12)]
    for width in (4, 1000):
        assert run(spark, rows, width) == want


def test_long_interval_over_many_bins_and_largest_positions(spark):
    rows = [("a", "x", 1, 2000), ("a", "x", 500, 3), ("a", "x", 2147483600, 47)]
    assert run(spark, rows, 16) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert intervals.periods_and_gaps(df, ["lib", "chrom"], "position", "span").count() == 0
    assert intervals.covered_bases(df, ["lib"], "position", "span").count() == 0
