"""Expressions over aligned reads: flags, strands, CIGAR strings and methylation states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(bits) == bits


def strand(flag: Column) -> Column:
    """Strand of the original molecule: the read's own for single reads, by mate number and orientation for pairs."""
    plus = (has(flag, 0x40) & has(flag, 0x20)) | (has(flag, 0x80) & has(flag, 0x10))
    minus = (has(flag, 0x40) & has(flag, 0x10)) | (has(flag, 0x80) & has(flag, 0x20))
    single = F.when(has(flag, 0x10), "-").otherwise("+")
    return F.when(~has(flag, 0x2), single).when(plus, "+").when(minus, "-")


def hit_type(flag: Column) -> Column:
    """1 to 4: forward and reverse of either strand; single reads have 1 and 4."""
    first = F.when(has(flag, 0x10), 4).otherwise(1)
    second = F.when(has(flag, 0x10), 3).otherwise(2)
    return F.when(~has(flag, 0x1), first).when(has(flag, 0x40), first).when(has(flag, 0x80), second)


def passes_quality(flag: Column, mapq: Column, least: int) -> Column:
    return (mapq >= least) & (flag.bitwiseAND(0x4 | 0x200) == 0)


def routing(flag: Column, chrom: Column, mate_chrom: Column, insert_size: Column, most: int) -> Column:
    """``single`` if the mate is unmapped, elsewhere, or at an insert size of 0 or beyond ``most``; else ``paired``."""
    alone = (
        ~has(flag, 0x1)
        | has(flag, 0x8)
        | ~F.coalesce((mate_chrom == "=") | (mate_chrom == chrom), F.lit(False))
        | (F.coalesce(insert_size, F.lit(0)) == 0)
        | (F.abs(insert_size) > most)
    )
    return F.when(alone, "single").otherwise("paired")


def cigar_length(cigar: Column, ops: str) -> Column:
    """Total length of the operations named in ``ops``."""
    parts = F.regexp_extract_all(cigar, F.lit(rf"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x.cast("int"))


def reference_length(cigar: Column) -> Column:
    return cigar_length(cigar, "MD")


def aligned_blocks(cigar: Column) -> Column:
    """Array of (``read_at``, ``ref_at``, ``len``), 0-based, one for each run of aligned bases."""
    lens = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MIDSN]"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit("[0-9]+([MIDSN])"), F.lit(1))
    empty = F.array().cast("array<struct<read_at:int,ref_at:int,len:int>>")
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), empty.alias("b"))

    def step(a: Column, x: Column) -> Column:
        n, op = x["n"].cast("int"), x["op"]
        block = F.struct(a["r"].alias("read_at"), a["g"].alias("ref_at"), n.alias("len"))
        return F.struct(
            F.when(op.isin("M", "I", "S"), a["r"] + n).otherwise(a["r"]).alias("r"),
            F.when(op.isin("M", "D", "N"), a["g"] + n).otherwise(a["g"]).alias("g"),
            F.when(op == "M", F.concat(a["b"], F.array(block))).otherwise(a["b"]).alias("b"),
        )

    both = F.zip_with(lens, ops, lambda n, o: F.struct(n.alias("n"), o.alias("op")))
    return F.aggregate(both, start, step)["b"]


def fold_states(state: Column) -> Column:
    """States folded to methylated, unmethylated, none, gap and bases (fixed table of the format)."""
    return F.translate(state, "MmXHZUuxhzNnIDacgt", "MMMMMUUUUU==OOACGT")


def strip_inserted(state: Column) -> Column:
    """Without inserted and clipped places, so that an index is a reference offset."""
    return F.translate(state, "SI", "")


def phred(p: Column) -> Column:
    return F.round(F.least(F.lit(100.0), -10 * F.log10(p)), 2)


def unphred(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def natural_order(chrom: Column) -> list[Column]:
    """Sort keys of the version order: text before the first number, that number, the rest."""
    return [
        F.regexp_extract(chrom, "^([^0-9]*)", 1),
        F.regexp_extract(chrom, "^[^0-9]*([0-9]*)", 1).try_cast("bigint"),
        F.regexp_extract(chrom, "^[^0-9]*[0-9]*(.*)$", 1),
    ]


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def context_of(five: Column) -> Column:
    """CG, CHG or CHH from the five bases around a cytosine at the third place."""
    after, second = F.substring(five, 4, 1), F.substring(five, 5, 1)
    return F.when(F.substring(five, 3, 1) != "C", None).when(after == "G", "CG").when(second == "G", "CHG").otherwise("CHH")
