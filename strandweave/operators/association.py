"""Association of neighbouring sites: pairs, contingency tables, exact tests, adjustment and regions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.intervals import attach
from strandweave.operators.rangejoin import bin_join, previous, running_total
from strandweave.session import cut_counted, cut_lineage

_SMALL = [math.lgamma(i + 1) for i in range(64)]
TIE = 1e-7
CHAIN_BIN = 1 << 18
P_BUCKET = 1 << 18
TABLES_BROADCAST = 200_000


def next_site_pairs(sites: DataFrame, bin_width: int = 1 << 18) -> DataFrame:
    """``chrom``, ``strand``, ``c1`` and ``c2``: each site with the next one of its chromosome and strand.

    Sites are ordered per bin of positions; the first site of the next non-empty bin is added on bin summaries, so no
    task orders a whole chromosome.
    """
    keys = ["chrom", "strand"]
    rows = sites.select(*keys, F.col("pos").cast("long").alias("pos")).distinct().withColumn("_bin", F.floor(F.col("pos") / bin_width))
    inside = rows.withColumn("c2", F.lead("pos").over(Window.partitionBy(*keys, "_bin").orderBy("pos")))
    first = rows.groupBy(*keys, "_bin").agg(F.min("pos").alias("_first"))
    later = first.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bin").alias("_b"), F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bin")).alias("_next"))
    at = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_bin") == F.col("_b")]
    return (
        inside.join(later, at)
        .select(*keys, F.col("pos").alias("c1"), F.coalesce("c2", "_next").alias("c2"))
        .filter(F.col("c2").isNotNull())
    )


def pair_counts(pairs: DataFrame, calls: DataFrame) -> DataFrame:
    """``mm``, ``mu``, ``um`` and ``uu`` per pair: reads by their state at both sites. ``calls`` has ``read_id``,
    ``chrom``, ``strand``, ``pos`` and ``methylated``, one row per read and position; a read counts where it has a call at
    both. Each pair is a site with its next one, so a read's calls at sites are taken one after the other: one join."""
    ends = pairs.select("chrom", "strand", F.col("c1").alias("pos"), "c2").unionByName(
        pairs.select("chrom", "strand", F.col("c2").alias("pos"), F.lit(None).cast("long").alias("c2"))
    )
    # written: what is joined with the calls is then known by its size, and small ones are broadcast
    sites = cut_lineage(ends.groupBy("chrom", "strand", "pos").agg(F.max("c2").alias("c2")))
    w = Window.partitionBy("read_id").orderBy("pos")
    seen = calls.select("read_id", "chrom", "strand", "pos", F.col("methylated").alias("m1")).join(sites, ["chrom", "strand", "pos"])
    both = seen.withColumns({"_at": F.lead("pos").over(w), "m2": F.lead("m1").over(w)}).filter(F.col("_at") == F.col("c2"))
    both = both.withColumnRenamed("pos", "c1")
    n = lambda a, b: F.count_if((F.col("m1") == a) & (F.col("m2") == b))
    return both.groupBy("chrom", "strand", "c1", "c2").agg(
        n(True, True).alias("mm"), n(True, False).alias("mu"), n(False, True).alias("um"), n(False, False).alias("uu")
    )


def ln_factorial(n: Column) -> Column:
    """From a table for small numbers, else by Stirling's series (error below 1e-12 from 64 on)."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < len(_SMALL), F.get(F.lit(_SMALL), n.cast("int"))).otherwise(series)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the table ((a, b), (c, d)): the probabilities of all tables with its margins that are no more
    likely, equal ones included."""
    m, n, k = a + c, b + d, a + b
    fixed = ln_factorial(m) + ln_factorial(n) + ln_factorial(k) + ln_factorial(m + n - k) - ln_factorial(m + n)

    def ln_p(i: Column) -> Column:
        return fixed - ln_factorial(i) - ln_factorial(m - i) - ln_factorial(k - i) - ln_factorial(n - k + i)

    lo, hi = F.greatest(F.lit(0).cast("long"), k - n), F.least(k, m)
    seen = ln_p(a)
    add = lambda total, i: total + F.when(ln_p(i) <= seen + TIE, F.exp(ln_p(i))).otherwise(0.0)
    return F.least(F.lit(1.0), F.aggregate(F.sequence(lo, hi), F.lit(0.0), add))


def test_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``p`` of the exact test and ``q``, adjusted over all of them. Equal tables are tested and adjusted once,
    with their number of pairs as weight, and joined back: by broadcast up to ``TABLES_BROADCAST`` of them."""
    four = ["mm", "mu", "um", "uu"]
    pairs = cut_lineage(pairs)
    tables = pairs.groupBy(*four).agg(F.count("*").alias("_w")).withColumn("p", fisher_exact(*[F.col(x) for x in four]))
    tables, seen = cut_counted(adjust_p(tables, "p", weight="_w").drop("_w"), n=F.count("*"))
    return pairs.join(F.broadcast(tables) if seen["n"] <= TABLES_BROADCAST else tables, four)


def adjust_p(df: DataFrame, p: str = "p", bucket: int = P_BUCKET, weight: str | None = None) -> DataFrame:
    """``df`` with ``q``, p adjusted for the false discovery rate over all rows, or, if a row stands for ``weight`` equal ones, over
    those. Rows without a p are left out.

    Equal p values are counted first. The different ones are put into ranges of about ``bucket`` and ordered within each; ranks
    and least values are carried over on one row per range, so no task orders all of them. p is not rounded.
    """
    df = cut_lineage(df)  # read twice, computed once
    counts = cut_lineage(df.groupBy(F.col(p).alias("_p")).agg(F.sum(weight if weight else F.lit(1)).alias("_n")).filter(F.col("_p").isNotNull()))
    n, total = counts.agg(F.count("*"), F.sum("_n")).first()
    parts = max(1, -(-n // bucket))
    ranged = cut_lineage(counts.repartitionByRange(parts, "_p").withColumn("_b", F.spark_partition_id())) if parts > 1 else counts.withColumn("_b", F.lit(0))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranged.groupBy("_b").agg(F.sum("_n").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carry"))
    up = Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ranks = attach(ranged, carry, ["_b"]).withColumn("_q", F.col("_p") * F.lit(total or 0) / (F.col("_carry") + F.sum("_n").over(up)))
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    least = ranks.groupBy("_b").agg(F.min("_q").alias("_m")).select("_b", F.coalesce(F.min("_m").over(after), F.lit(1.0)).alias("_least"))
    down = Window.partitionBy("_b").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.col("_least"), F.min("_q").over(down))
    return df.join(attach(ranks, least, ["_b"]).select("_p", q.alias("q")), F.col(p) == F.col("_p")).drop("_p")


def dominance(counts: list[Column]) -> tuple[Column, Column]:
    """Share of the two largest counts, and the logarithm of their ratio (0 if the second is 0)."""
    top = F.sort_array(F.array(*counts), asc=False)
    total = sum(counts[1:], counts[0])
    one, two = F.get(top, F.lit(0)), F.get(top, F.lit(1))
    return F.when(total > 0, (one + two) / total).otherwise(0.0), F.when(two > 0, F.log(one / two)).otherwise(0.0)


def allele_specific_regions(
    pairs: DataFrame, most_p: float = 0.01, weight: float = 0.8, fold: float = 2.0, depth: tuple[int, int] = (4, 1000), sites: int = 4
) -> DataFrame:
    """Regions of at least ``sites`` sites from significant, dominated pairs that follow each other without a break:
    ``chrom``, ``strand``, ``start_pos``, ``end_pos``, ``label`` and ``n_sites``."""
    counts = [F.col(x) for x in ("mm", "mu", "um", "uu")]
    share, ratio = dominance(counts)
    total = sum(counts[1:], counts[0])
    kept = pairs.filter((F.round("p", 6) <= most_p) & (share >= weight) & (ratio <= fold) & total.between(*depth))
    keys = ["chrom", "strand"]
    follows = previous(kept, keys, "c1", "c2", "_prev", CHAIN_BIN)
    new = F.when(F.col("_prev") == F.col("c1"), 0).otherwise(1)
    return (
        running_total(follows, keys, "c1", new, "_chain", CHAIN_BIN)
        .groupBy("chrom", "strand", "_chain")
        .agg(F.min("c1").alias("start_pos"), F.max("c2").alias("end_pos"), (F.count("*") + 1).alias("n_sites"))
        .filter(F.col("n_sites") >= sites)
        .select("chrom", "strand", "start_pos", "end_pos", F.concat(F.lit("Meth:"), F.col("end_pos") - F.col("start_pos")).alias("label"), "n_sites")
    )


def calls_in_reads(sites: DataFrame, reads: DataFrame) -> DataFrame:
    """Sites joined with the reads that cover them: ``sites`` (chrom, strand, pos), ``reads`` (read_id, chrom, strand,
    start_pos, end_pos)."""
    return bin_join(sites, reads, ["chrom", "strand"], "pos", "start_pos", "end_pos")
