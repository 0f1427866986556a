import random

import pytest

from strandweave.operators import methcall

READS = "read_id string, chrom string, strand string, start_pos long, end_pos long, cigar string, seq string, flag int"


def letters(ref, at, base, plus):
    get = lambda i: ref[i] if 0 <= i < len(ref) else "N"
    r = get(at)
    near, c, t = ((get(at + 1), get(at + 2)), "C", "T") if plus else ((get(at - 1), get(at - 2)), "G", "A")
    if r == c and base in (c, t):
        x = "Z" if near[0] == ("G" if plus else "C") else "X" if near[1] == ("G" if plus else "C") else "H"
        return x if base == c else x.lower()
    return "=" if base == r else base


@pytest.mark.parametrize("chunk", [7, 64])
def test_states_against_a_walk_in_python(spark, chunk):
    rnd = random.Random(3)
    ref = "".join(rnd.choice("ACGT") for _ in range(180))
    chunks = [("c", k, ref[k * chunk : (k + 1) * chunk].ljust(chunk, "N")) for k in range(-(-len(ref) // chunk)) if k != 3]
    known = "".join(c if i // chunk != 3 else "N" for i, c in enumerate(ref))
    rows, want = [], {}
    for i in range(60):
        ops = rnd.choice([[(20, "M")], [(5, "M"), (2, "I"), (9, "M")], [(3, "S"), (8, "M"), (3, "D"), (6, "M")], [(1, "M")], [(4, "M"), (0, "I"), (4, "M"), (2, "S")]])
        at = start = rnd.choice([0, 1, 2, rnd.randrange(150)])
        plus, seq, state, original = i % 2 == 0, "", "", ""
        for n, op in ops:
            if op == "D":
                state, at = state + "D" * n, at + n
                continue
            for _ in range(n):
                base = rnd.choice([ref[at], ref[at].translate(str.maketrans("CG", "TA")), "A"]) if op == "M" else rnd.choice("ACGT")
                s = letters(known, at, base, plus) if op == "M" else op
                seq, state, original = seq + base, state + s, original + (("C" if plus else "G") if s in "zxh" else base)
                at += op == "M"
        rows.append((f"r{i}", "c", "+" if plus else "-", start, at - 1, "".join(f"{n}{o}" for n, o in ops), seq.lower() if i % 5 == 0 else seq, 0))
        want[f"r{i}"] = (state, original)
    rows += [("n", "c", "+", 1, 5, "2M1N2M", "ACGT", 0), ("o", "c", None, 1, 4, "4M", "ACGT", 0), ("p", "c", "+", 1, 4, "4M", None, 0), ("q", "d", "+", 5, 6, "2M", "AC", 0)]
    got = methcall.call_states(spark.createDataFrame(rows, READS), spark.createDataFrame(chunks, "chrom string, chunk long, seq string"), chunk).collect()
    assert {r.read_id: (r.state, r.original) for r in got} == want | {"q": ("AC", "AC")}


def test_consensus_takes_the_most_votes_and_fills_gaps(spark):
    votes = [("c", 3, "A"), ("c", 3, "G"), ("c", 3, "G"), ("c", 5, "T"), ("c", 5, "C"), ("c", 6, "N"), ("c", 9, "A"), ("d", 0, "T")]
    got = {(r.chrom, r.chunk): r.seq for r in methcall.consensus(spark.createDataFrame(votes, "chrom string, pos long, base string"), 8).collect()}
    assert got == {("c", 0): "NNNGNCNN", ("c", 1): "NANNNNNN", ("d", 0): "TNNNNNNN"}


def test_counts_of_both_strands(spark):
    rows = [("a", "c", "+", 2, 5, "4M", "ACGT", 0), ("b", "c", "+", 2, 5, "4M", "ATGT", 0), ("c", "c", "-", 2, 5, "4M", "ACAT", 16), ("d", "c", "-", 2, 5, "4M", "ATGT", 16)]
    chunks = spark.createDataFrame([("c", 0, "NNACGTNN")], "chrom string, chunk long, seq string")
    got = sorted(map(tuple, methcall.state_counts(methcall.call_states(spark.createDataFrame(rows, READS), chunks, 8)).collect()))
    assert got == [("c", "+", 3, "CG", 1, 2, 1, 2), ("c", "-", 4, "CG", 1, 2, 2, 2)]


def test_empty(spark):
    chunks = spark.createDataFrame([], "chrom string, chunk long, seq string")
    assert methcall.state_counts(methcall.call_states(spark.createDataFrame([], READS), chunks)).count() == 0
    assert methcall.consensus(spark.createDataFrame([], "chrom string, pos long, base string")).count() == 0
