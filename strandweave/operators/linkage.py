"""Pileups, linkage of variants, and mates that see different haplotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRANS_BIN = 5000
LOWEST = 1e-4


def pileup(blocks: DataFrame, least_depth: int = 2) -> DataFrame:
    """``chrom``, ``pos`` and the counts of each base of aligned runs (chrom, s, bases), where enough reads meet."""
    rows = blocks.select("chrom", "s", F.posexplode(F.split(F.upper("bases"), "")).alias("i", "b"))
    n = lambda b: F.count_if(F.col("b") == b).alias(b.lower())
    return (
        rows.groupBy("chrom", (F.col("s") + F.col("i")).alias("pos"))
        .agg(F.count("*").alias("depth"), n("A"), n("C"), n("G"), n("T"))
        .filter(F.col("depth") >= least_depth)
    )


def linkage(calls: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n`` and ``r2`` of variants that follow each other in fragments; null where one of them does not vary."""
    w = Window.partitionBy("frag_id").orderBy("varid")
    pairs = calls.select(F.col("varid").alias("a"), F.lead("varid").over(w).alias("b"), F.col("allele").alias("x"), F.lead("allele").over(w).alias("y")).filter(F.col("b").isNotNull())
    t = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("x").alias("p"), F.avg("y").alias("q"), F.avg(F.col("x") * F.col("y")).alias("pq"))
    d = F.col("pq") - F.col("p") * F.col("q")
    spread = F.col("p") * (1 - F.col("p")) * F.col("q") * (1 - F.col("q"))
    return t.select("a", "b", "n", F.when(spread > 1e-12, d * d / spread).alias("r2"))


def _both_cases(calls: DataFrame, haplotype: DataFrame) -> DataFrame:
    """``frag_id``, ``isize`` and the log10 likelihoods ``cis`` and ``trans`` of fragments with calls of both mates."""
    e = F.pow(F.lit(10.0), -F.col("qv") / 10.0)
    rows = calls.filter("qv >= 6").join(haplotype, "varid")
    fits = F.col("allele") == F.col("hap")
    side = lambda flip: F.sum(F.log10(F.when(fits != flip, 1 - e).otherwise(e)))
    mates = rows.groupBy("frag_id", "second").agg(F.max("isize").alias("isize"), side(F.lit(False)).alias("h1"), side(F.lit(True)).alias("h2"))
    one = mates.filter(~F.col("second")).select("frag_id", "isize", F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    two = mates.filter("second").select("frag_id", F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    both = one.join(two, "frag_id").filter(F.col("isize").isNotNull())
    like = lambda x, y: log_sum(F.col("a1") + F.col(x), F.col("a2") + F.col(y))
    return both.select("frag_id", "isize", like("b1", "b2").alias("cis"), like("b2", "b1").alias("trans"))


def log_sum(a: Column, b: Column) -> Column:
    """log10(10**a + 10**b)."""
    return F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(a - b)))


def trans_likelihood(calls: DataFrame, haplotype: DataFrame) -> DataFrame:
    """``frag_id`` and ``ll``, the log10 likelihood of fragments of two mates that see different haplotypes at the rate of
    their insert-size bin. There is one rate per bin."""
    rates = trans_rates(calls, haplotype).select(F.col("bin").alias("_bin"), "rate")
    rows = _both_cases(calls, haplotype).join(rates, F.floor(F.abs("isize") / TRANS_BIN) == F.col("_bin"))
    return rows.select("frag_id", log_sum(F.log10(1 - F.col("rate")) + F.col("cis"), F.log10("rate") + F.col("trans")).alias("ll"))


def trans_rates(calls: DataFrame, haplotype: DataFrame, halvings: int = 40) -> DataFrame:
    """``bin``, ``n`` and ``rate``: for fragments of two mates (frag_id, isize, second, varid, allele, qv), how often the
    mates see different haplotypes, per insert-size bin.

    The log likelihood of a fragment with both mates on one haplotype, and on different ones, is summed per fragment, so
    that long fragments do not underflow. Fragments are reduced to the rounded share of the latter; the slope of a bin's
    likelihood falls with the rate, so its maximum is enclosed by ``halvings`` halvings over few rows per bin.
    """
    both = _both_cases(calls, haplotype)
    ratio = F.round(1 / (1 + F.pow(F.lit(10.0), F.least(F.col("cis") - F.col("trans"), F.lit(300.0)))), 4)
    weights = both.groupBy(F.floor(F.abs("isize") / TRANS_BIN).alias("bin"), ratio.alias("t")).agg(F.count("*").alias("n"))
    lists = weights.groupBy("bin").agg(F.sum("n").alias("n"), F.collect_list(F.struct("t", "n")).alias("w"))  # at most 10,001 ratios a bin
    span = F.struct(F.lit(LOWEST).alias("lo"), F.lit(1 - LOWEST).alias("hi"))

    def step(span, _):
        at = (span["lo"] + span["hi"]) / 2
        slope = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["n"] * (2 * x["t"] - 1) / (at * x["t"] + (1 - at) * (1 - x["t"])))
        return F.struct(F.when(slope > 0, at).otherwise(span["lo"]).alias("lo"), F.when(slope > 0, span["hi"]).otherwise(at).alias("hi"))

    return lists.select("bin", "n", F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), span, step, lambda s: (s["lo"] + s["hi"]) / 2).alias("rate"))
