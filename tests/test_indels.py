import random

import numpy as np
import pytest

from strandweave.operators import indels, methcall

READ = "read_id string, chrom string, start_pos long, end_pos long, cigar string, seq string"


def reference(spark, text, chrom="c"):
    """Chunks of 1024 bases; ``text`` begins at position 1."""
    whole = "N" + text
    whole += "N" * (-len(whole) % methcall.CHUNK)
    rows = [(chrom, i // methcall.CHUNK, whole[i : i + methcall.CHUNK]) for i in range(0, len(whole), methcall.CHUNK)]
    return spark.createDataFrame(rows, "chrom string, chunk long, seq string")


def needleman(a, b, hit, miss, skip):
    t = np.zeros((len(a) + 1, len(b) + 1))
    t[:, 0], t[0, :] = np.arange(len(a) + 1) * skip, np.arange(len(b) + 1) * skip
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = hit if a[i - 1] == b[j - 1] or "N" in (a[i - 1], b[j - 1]) else miss
            t[i, j] = max(t[i - 1, j - 1] + s, t[i - 1, j] + skip, t[i, j - 1] + skip)
    return t[-1, -1]


def test_scores_against_one_by_one():
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("ACGTN") for _ in range(n))
    a, b = [word(rnd.randint(0, 9)) for _ in range(60)] + [""], [word(rnd.randint(0, 9)) for _ in range(60)] + [""]
    got = indels.log_scores(a, b)
    args = np.log10(1 - indels.ERROR), np.log10(indels.ERROR / 3), np.log10(indels.GAP)
    assert got == pytest.approx([needleman(x, y, *args) for x, y in zip(a, b)])
    assert len(indels.log_scores([], [])) == 0


def test_indels_of_reads(spark):
    rows = [
        ("a", "c", 10, 20, "4M2D3M1I2M", "ACGTACGTTT"),
        ("b", "c", 10, 13, "2I4M", "ACGTAC"),  # before the first aligned base: no place
        ("d", "c", 10, 13, None, "ACGT"),
        ("e", "c", 10, 13, "*", "ACGT"),
        ("f", "c", 10, 13, "2M1I2M", None),
    ]
    got = sorted(tuple(r) for r in indels.read_indels(spark.createDataFrame(rows, READ)).collect())
    assert got == [("a", "c", 14, 2, ""), ("a", "c", 19, 0, "T")]


@pytest.mark.parametrize("window", [3, 64])
def test_shift(spark, window):
    text = "ACGT" + "CA" * 40 + "GGGGG" + "TACG"
    rnd = random.Random(6)
    cases = [("c", p, n, "") for p in (5, 6, 60, 85, 88) for n in (1, 2, 4)] + [("c", p, 0, s) for p in (5, 7, 30, 86) for s in ("CA", "AC", "G", "CACA", "T")]
    cases += [("c", rnd.randint(1, len(text)), rnd.randint(1, 5), "") for _ in range(10)] + [("c", len(text) + 50, 1, ""), ("other", 5, 1, "")]
    df = spark.createDataFrame(cases + cases[:3], "chrom string, pos long, n_deleted int, inserted string")
    got = {tuple(r)[:4]: r["shift"] for r in indels.right_shift(df, reference(spark, text), window).collect()}

    def want(chrom, pos, n, ins):
        if chrom != "c":
            return 0
        shift = 0
        at = lambda i: text[i - 1] if 1 <= i <= len(text) else None
        while at(pos + shift) is not None and at(pos + shift) == (at(pos + shift + n) if n else (ins[shift] if shift < len(ins) else at(pos + shift - len(ins)))):
            shift += 1
        return shift

    assert got == {c: want(*c) for c in set(cases)}
    assert max(got.values()) > 64


def test_no_indels(spark):
    none = spark.createDataFrame([], "chrom string, pos long, n_deleted int, inserted string")
    assert indels.right_shift(none, reference(spark, "ACGT")).collect() == []
    reads = spark.createDataFrame([("a", "c", 1, 4, "4M", "ACGT")], READ)
    assert indels.realign(none, reads, reference(spark, "ACGT")).collect() == []
    assert indels.realign(none, reads.limit(0), reference(spark, "ACGT").limit(0)).collect() == []


def test_realign(spark):
    rnd = random.Random(7)
    text = "".join(rnd.choice("ACGT") for _ in range(2000))
    cut, extra = 1020, "GATTACA"  # about the border of two chunks
    with_cut = text[: cut - 1] + text[cut + 4 :]  # bases 1020 .. 1024 are left out
    with_extra = text[: cut - 1] + extra + text[cut - 1 :]
    rows = [
        ("cut", "c", 991, 1055, "29M5D31M", with_cut[990:1050]),
        ("cut_elsewhere", "c", 991, 1057, "32M5D30M", with_cut[990:1052]),  # the aligner put it three bases on
        ("whole", "c", 991, 1050, "60M", text[990:1050]),
        ("extra", "c", 991, 1050, "29M7I31M", with_extra[990:1057]),
        ("away", "c", 100, 159, "60M", text[99:159]),
        ("ends_at", "c", 1000, 1019, "20M", text[999:1019]),
        ("no_bases", "c", 991, 1050, "60M", None),
        ("no_cigar", "c", 991, 1050, None, text[990:1050]),
        (None, None, None, None, None, None),
    ]
    found = spark.createDataFrame([("c", cut, 5, ""), ("c", cut, 0, extra), ("c", cut, 5, "")], "chrom string, pos long, n_deleted int, inserted string")
    out = indels.realign(found, spark.createDataFrame(rows, READ), reference(spark, text)).collect()
    got = {(r.read_id, r.n_deleted): r.allele for r in out}
    assert len(out) == len(got)
    assert {k[0]: v for k, v in got.items() if k[1] == 5} == {"cut": 1, "cut_elsewhere": 1, "whole": 0, "extra": 0}
    assert got["extra", 0] == 1 and got["whole", 0] == 0 and got["cut", 0] == 0
    assert all(r.qv > 10 for r in out if r.read_id in ("cut", "whole", "extra") and (r.n_deleted == 5 or r.read_id != "cut"))
