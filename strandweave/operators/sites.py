"""Methylation sites: filters, corrected ratios, categories, densities and totals.

``sites`` frames have chrom, pos, strand, context, mc (methylated calls), cov (coverage) and, where they come from
ratio files, rev_g and rev_ga.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = (("M", 0.8), ("Mh", 0.6), ("H", 0.4), ("hU", 0.2))  # fixed values; below them U


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order`` (then by the columns): an aggregate, so repeats of a hot key are
    reduced on the map side."""
    rest = [c for c in columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def heterozygous(sites: DataFrame, least_mc: int = 2, least_cov: int = 6, ratio: float = 0.1, both_alleles: bool = True) -> DataFrame:
    """Sites with enough coverage whose ratio is in ``ratio`` .. ``1 - ratio``; ``both_alleles`` also asks for more than
    two calls of either kind."""
    share = F.col("mc") / F.col("cov")
    keep = (F.col("mc") >= least_mc) & (F.col("cov") >= least_cov) & (share >= ratio) & (share <= 1 - ratio)
    if both_alleles:
        keep = keep & (F.col("mc") > 2) & (F.col("cov") - F.col("mc") > 2)
    return sites.filter(keep)


def pseudo_variants(sites: DataFrame) -> DataFrame:
    """Sites as heterozygous variants of a bisulfite strand: C to T on plus, G to A on minus."""
    plus = F.col("strand") == "+"
    return sites.select(
        "chrom",
        "pos",
        "strand",
        F.when(plus, "C").otherwise("G").alias("ref"),
        F.when(plus, "T").otherwise("A").alias("alt"),
        F.lit(600).alias("qual"),
        F.lit("PASS").alias("filter_tag"),
        F.lit("0/1").alias("gt"),
    )


def bisulfite_safe(ref: Column, alt: Column, strand: str) -> Column:
    """False for substitutions that bisulfite conversion imitates on the strand; case does not matter."""
    pair = F.concat(F.upper(ref), F.upper(alt))
    return ~pair.isin(*(("CT", "TC") if strand == "+" else ("GA", "AG")))


def corrected_ratio() -> Column:
    """Methylated share, with the covered reads scaled by the other strand's G share where more than 20 reads tell it."""
    scaled = F.col("cov") * (F.col("rev_g") / F.col("rev_ga"))
    plain = F.col("mc") / F.col("cov")
    return F.when((F.col("rev_ga") > 20) & (F.col("rev_g") > 0), F.least(F.lit(1.0), F.col("mc") / scaled)).otherwise(plain)


def category(ratio: Column) -> Column:
    out = F.lit("U")
    for name, least in reversed(CATEGORIES):
        out = F.when(ratio >= least, name).otherwise(out)
    return out


def category_histogram(sites: DataFrame) -> DataFrame:
    return sites.groupBy("context", category(F.col("mc") / F.col("cov")).alias("category")).agg(F.count("*").alias("n_sites"))


def density(sites: DataFrame, bins: int = 100) -> DataFrame:
    """Sites per context and percent bin of their ratio; 1 falls into the last bin."""
    at = F.least(F.floor(F.lit(bins) * F.col("mc") / F.col("cov")), F.lit(bins - 1))
    return sites.groupBy("context", at.alias("bin")).agg(F.count("*").alias("n_sites"))


def region_sums(sites: DataFrame, width: int = 1000, least_sites: int = 2) -> DataFrame:
    """Calls per fixed region, strand and context, where it has enough sites."""
    return (
        sites.groupBy("chrom", F.floor(F.col("pos") / width).alias("region"), "strand", "context")
        .agg(F.count("*").alias("n_sites"), F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
        .filter(F.col("n_sites") >= least_sites)
    )


def sliding_bins(sites: DataFrame, step: int = 1000, least_cov: int = 10) -> DataFrame:
    """Windows of two steps at each step: a bin with the one before it, if that is not empty."""
    bins = sites.groupBy("chrom", "context", F.floor(F.col("pos") / step).alias("bin")).agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    w = Window.partitionBy("chrom", "context").orderBy("bin").rangeBetween(-1, 0)
    return (
        bins.select("chrom", "context", "bin", F.sum("mc").over(w).alias("mc"), F.sum("cov").over(w).alias("cov"))
        .filter(F.col("cov") > least_cov)
    )


def totals(sites: DataFrame) -> DataFrame:
    """Calls by strand and context, with all their margins; ``all`` stands for a margin."""
    named = lambda c: F.coalesce(F.col(c), F.lit("all")).alias(c)
    return sites.cube("strand", "context").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov")).select(named("strand"), named("context"), "mc", "cov")
