"""Merging haplotype blocks of the plus and the minus strand.

``links`` frames have one row per phased position of a block: block_id, chrom, pos, hap1, hap2 and source (1 plus, 2
minus). Where a plus and a minus block meet, each meeting position votes for or against their haplotypes agreeing:
cytosines of one CpG (plus position + 1 = minus position) and positions phased on both strands. A block pair with more
votes for agreement is merged as it is, one with more against it after swapping the minus haplotypes, a tie is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHT = 2
LEAST_SCORE = 2

# Scores of four letters (plus and minus base of the first haplotype, then of the second), for positions phased
# on both strands and for the cytosines of one CpG. Conversion can turn C into T on the plus and G into A on the minus strand.
# Equal bases on both haplotypes score AGREE, all others not named the negative one.
AGREE, AGREE_CPG = 6, 4
SHARED_SCORES = {
    "TCTT": 0, "TCAA": 6, "TCCC": 6, "TCGG": 6, "TCGA": 4,
    "CCGA": 6, "TTTC": 0, "GGTC": 6,
    "GAAA": 0, "GACC": 6, "GAGG": 6, "GATT": 6, "GATC": 4,
    "AATC": 6, "AAGA": 6,
}
CPG_SCORES = ("CGTA", "TACG")


def _meetings(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions of plus and minus blocks that are of one CpG, and those that are the same. Equi-joins on position."""
    side = lambda s, n: links.filter(F.col("source") == s).select(
        "chrom", F.col("pos").alias(f"{n}_pos"), F.col("block_id").alias(f"{n}_block"), F.col("hap1").alias(f"{n}1"), F.col("hap2").alias(f"{n}2")
    )
    plus, minus = side(1, "p"), side(2, "m")
    cpg = plus.join(minus.withColumnRenamed("chrom", "_c"), (F.col("chrom") == F.col("_c")) & (F.col("p_pos") + 1 == F.col("m_pos")))
    snv = plus.join(minus.withColumnRenamed("chrom", "_c"), (F.col("chrom") == F.col("_c")) & (F.col("p_pos") == F.col("m_pos")))
    return cpg, snv


def strand_votes(links: DataFrame) -> DataFrame:
    """``plus_block``, ``minus_block``, ``score`` and ``n_votes`` per pair of blocks that meet."""
    cpg, snv = _meetings(links)
    both = F.concat("p1", "p2", "m1", "m2")
    cpg = cpg.withColumn("v", F.when(both.isin("CTGA", "TCAG"), WEIGHT).when(both.isin("CTAG", "TCGA"), -WEIGHT))
    same = (F.col("p1") == F.col("m1")) & (F.col("p2") == F.col("m2"))
    swapped = (F.col("p1") == F.col("m2")) & (F.col("p2") == F.col("m1"))
    snv = snv.withColumn("v", F.when(same, WEIGHT).when(swapped, -WEIGHT))
    votes = cpg.unionByName(snv).filter(F.col("v").isNotNull())
    return votes.groupBy(F.col("p_block").alias("plus_block"), F.col("m_block").alias("minus_block")).agg(
        F.sum("v").alias("score"), F.count("*").alias("n_votes")
    )


def shared_votes(links: DataFrame) -> DataFrame:
    """The same for blocks of any two sources, by the positions that both phase: cytosines of one CpG do not vote."""
    _, snv = _meetings(links)
    same = (F.col("p1") == F.col("m1")) & (F.col("p2") == F.col("m2"))
    swapped = (F.col("p1") == F.col("m2")) & (F.col("p2") == F.col("m1"))
    votes = snv.withColumn("v", F.when(same, WEIGHT).when(swapped, -WEIGHT)).filter(F.col("v").isNotNull())
    return votes.groupBy(F.col("p_block").alias("plus_block"), F.col("m_block").alias("minus_block")).agg(F.sum("v").alias("score"), F.count("*").alias("n_votes"))


def _shared_score(letters: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SHARED_SCORES.items() for x in pair])
    equal = (F.substring(letters, 1, 1) == F.substring(letters, 2, 1)) & (F.substring(letters, 3, 1) == F.substring(letters, 4, 1))
    return F.when(equal, AGREE).otherwise(F.coalesce(F.try_element_at(table, letters), F.lit(-AGREE)))


def weighted_votes(links: DataFrame) -> DataFrame:
    """Pairs of blocks scored both ways by what conversion can do to a base: ``kept`` for the haplotypes as they are and ``swapped``
    for the minus ones swapped. A pair votes if one way scores at least ``LEAST_SCORE`` and the other at most its negative; its
    ``score`` is the difference of both ways, otherwise 0."""
    cpg, snv = _meetings(links)
    score_cpg = lambda x: F.when(x.isin(*CPG_SCORES), AGREE_CPG).otherwise(-AGREE_CPG)
    kept, swapped = F.concat("p1", "m1", "p2", "m2"), F.concat("p1", "m2", "p2", "m1")
    whole = kept.isNotNull()
    cytosine = F.col("p1").isin("C", "T") & F.col("p2").isin("C", "T")
    each = cpg.filter(whole & cytosine).select("p_block", "m_block", score_cpg(kept).alias("k"), score_cpg(swapped).alias("s"))
    each = each.unionByName(snv.filter(whole).select("p_block", "m_block", _shared_score(kept).alias("k"), _shared_score(swapped).alias("s")))
    sums = each.groupBy(F.col("p_block").alias("plus_block"), F.col("m_block").alias("minus_block")).agg(F.sum("k").alias("kept"), F.sum("s").alias("swapped"), F.count("*").alias("n_votes"))
    clear = (F.greatest("kept", "swapped") >= LEAST_SCORE) & (F.least("kept", "swapped") <= -LEAST_SCORE)
    return sums.withColumn("score", F.when(clear, F.col("kept") - F.col("swapped")).otherwise(0))


def merge_strands(links: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """``links`` after merging each minus block into the plus block it has the strongest vote with: block_id, chrom, pos,
    hap1, hap2, source. A position phased on both strands keeps the plus row. ``votes`` may be those of ``shared_votes`` or
    ``weighted_votes``; by default they are those of ``strand_votes``."""
    votes = (strand_votes(links) if votes is None else votes).filter("score <> 0")
    best = F.row_number().over(Window.partitionBy("minus_block").orderBy(F.desc(F.abs("score")), "plus_block"))
    chosen = votes.withColumn("_r", best).filter("_r = 1").select(F.col("minus_block").alias("_m"), "plus_block", "score")
    moved = links.filter("source = 2").join(chosen, F.col("block_id") == F.col("_m"), "left")
    flip = F.coalesce(F.col("score") < 0, F.lit(False))
    minus = moved.select(
        F.coalesce("plus_block", "block_id").alias("block_id"),
        "chrom",
        "pos",
        F.when(flip, F.col("hap2")).otherwise(F.col("hap1")).alias("hap1"),
        F.when(flip, F.col("hap1")).otherwise(F.col("hap2")).alias("hap2"),
        "source",
    )
    rows = links.filter("source = 1").select("block_id", "chrom", "pos", "hap1", "hap2", "source").unionByName(minus)
    first = F.min(F.struct("source", "hap1", "hap2")).alias("_f")
    return rows.groupBy("block_id", "chrom", "pos").agg(first).select("block_id", "chrom", "pos", "_f.hap1", "_f.hap2", "_f.source")
