"""Queries over ratio files and called bases: site filters, totals, pairs, tests and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import reads as fr
from strandweave.operators import association, sites as st
from strandweave.plans import views
from strandweave.session import cut_lineage, read_table

RATIO = 0.1


def het_sites_asm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.heterozygous(views.sites(spark, sf_dir), ratio=RATIO).select("chrom", "pos", "strand", "context", "mc", "cov")


def het_sites_hap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.heterozygous(views.sites(spark, sf_dir), ratio=RATIO, both_alleles=False)
    return found.filter(F.col("context") == "CG").select("chrom", "pos", "strand", "mc", "cov")


def split_sites_by_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.pseudo_variants(st.heterozygous(views.sites(spark, sf_dir), ratio=RATIO, both_alleles=False))


def corrected_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sites(spark, sf_dir).select("chrom", "pos", "strand", "context", F.round(st.corrected_ratio(), 6).alias("ratio"))


def meth_category_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.category_histogram(views.sites(spark, sf_dir))


def meth_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.density(views.sites(spark, sf_dir))


def region_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.region_sums(views.sites(spark, sf_dir))


def sliding_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.sliding_bins(views.sites(spark, sf_dir))


def strand_context_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.totals(views.sites(spark, sf_dir))


def weighted_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval statistics per chrom and context: plain and weighted mean, deviation, extremes and coverage."""
    level = F.col("mc") / F.col("cov")
    return views.sites(spark, sf_dir).groupBy("chrom", "context").agg(
        F.round(F.avg(level), 6).alias("mean_level"),
        F.round(F.sum("mc") / F.sum("cov"), 6).alias("weighted_level"),
        F.round(F.stddev_pop(level), 6).alias("sd_level"),
        F.round(F.max(level), 6).alias("max_level"),
        F.round(F.min(level), 6).alias("min_level"),
        F.sum("cov").alias("cov"),
    )


def zoom_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups of the signal at three widths, each made from the finer one."""
    made = None
    rows = views.sites(spark, sf_dir).select("chrom", F.col("pos").cast("long").alias("at"), F.lit(1).cast("long").alias("n"), F.col("mc").cast("long").alias("mc"), F.col("cov").cast("long").alias("cov"))
    for width in (1_000, 10_000, 100_000):
        rows = rows.groupBy("chrom", (F.floor(F.col("at") / width) * width).alias("at")).agg(F.sum("n").alias("n"), F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
        level = rows.select(F.lit(width).alias("width"), "*")
        made = level if made is None else made.unionByName(level)
    return made


def drop_bs_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants usable on each strand."""
    v = read_table(spark, sf_dir, "readvariant").filter((F.col("filter_tag") == "PASS") & (F.length("ref_allele") == 1) & (F.length("alt_allele") <= 3))
    part = lambda s: v.filter(st.bisulfite_safe(F.col("ref_allele"), F.col("alt_allele"), s)).select("varid", F.lit(s).alias("strand"), "chrom", "position")
    return part("+").unionByName(part("-"))


def call_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.base_calls(spark, sf_dir).groupBy("strand", "context").agg(F.count_if("methylated").alias("methylated"), F.count_if(~F.col("methylated")).alias("unmethylated"))


def _called_sites(calls: DataFrame) -> DataFrame:
    return calls.groupBy("chrom", "strand", "pos", "context").agg(F.count_if("methylated").alias("mc"), F.count("*").alias("cov"))


def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _called_sites(views.base_calls(spark, sf_dir))


def next_site_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.next_site_pairs(st.heterozygous(views.sites(spark, sf_dir), ratio=RATIO))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of neighbouring called sites; a site needs calls in two reads at least."""
    calls = cut_lineage(views.base_calls(spark, sf_dir))
    sites = cut_lineage(calls.groupBy("chrom", "strand", "pos").agg(F.count("*").alias("cov")).filter(F.col("cov") >= 2))
    return association.pair_counts(association.next_site_pairs(sites), calls)


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.test_pairs(_pairs(spark, sf_dir))


def pair_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact test and adjusted p of each pair; both strands are adjusted together. Rounded at the end only."""
    return _tested(spark, sf_dir).withColumns({"p": F.round("p", 6), "q": F.round("q", 6)})


def dominance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    share, ratio = association.dominance([F.col(x) for x in ("mm", "mu", "um", "uu")])
    return _pairs(spark, sf_dir).select("chrom", "strand", "c1", "c2", F.round(share, 6).alias("share"), F.round(ratio, 6).alias("ratio"))


LOOSE = {"most_p": 1.0, "depth": (2, 1000), "sites": 3}  # single-site coverage here is low


def asm_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.allele_specific_regions(_tested(spark, sf_dir), **LOOSE)


def asm_regions_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions under the operator's own limits; few or none where coverage is low."""
    return association.allele_specific_regions(_tested(spark, sf_dir))


def states_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each folded state occurs in reads."""
    state = F.explode(F.split(fr.fold_states(fr.strip_inserted(F.col("meth_state"))), "")).alias("state")
    return views.reads(spark, sf_dir, ["meth_state"]).select(state).groupBy("state").agg(F.count("*").alias("n"))


def context_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context from the five bases around a site, forward and read as the other strand."""
    rows = read_table(spark, sf_dir, "methratio").filter(F.length("ctx5") == 5)
    five = F.col("ctx5")
    return rows.groupBy(fr.context_of(five).alias("forward"), fr.context_of(fr.reverse_complement(five)).alias("backward")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        het_sites_asm, het_sites_hap, split_sites_by_strand, corrected_ratios, meth_category_hist, meth_density, region_sums, sliding_bins,
        strand_context_totals, weighted_levels, zoom_levels, drop_bs_ambiguous, call_totals, site_counts, next_site_pairs, pair_counts,
        pair_tests, dominance_filter, asm_regions, asm_regions_strict, states_folded, context_classes,
    )
}

_HET = f"mc >= 2 AND cov >= 6 AND mc / cov >= {RATIO} AND mc / cov <= 1 - {RATIO}"
_BOTH = f"{_HET} AND mc > 2 AND cov - mc > 2"
_CATEGORY = "CASE WHEN mc / cov >= 0.8 THEN 'M' WHEN mc / cov >= 0.6 THEN 'Mh' WHEN mc / cov >= 0.4 THEN 'H' WHEN mc / cov >= 0.2 THEN 'hU' ELSE 'U' END"
_PAIRS = (
    views.CALLS
    + """,
  near AS (SELECT chrom, strand, pos AS c1, lead(pos) OVER (PARTITION BY chrom, strand ORDER BY pos) AS c2
    FROM (SELECT chrom, strand, pos FROM calls GROUP BY ALL HAVING count(*) >= 2)),
  pairs AS (SELECT n.chrom, n.strand, c1, c2, count(*) FILTER (a.methylated AND b.methylated) AS mm, count(*) FILTER (a.methylated AND NOT b.methylated) AS mu,
      count(*) FILTER (NOT a.methylated AND b.methylated) AS um, count(*) FILTER (NOT a.methylated AND NOT b.methylated) AS uu
    FROM near n JOIN calls a ON a.chrom = n.chrom AND a.strand = n.strand AND a.pos = c1
    JOIN calls b ON b.read_id = a.read_id AND b.chrom = n.chrom AND b.strand = n.strand AND b.pos = c2 GROUP BY n.chrom, n.strand, c1, c2)"""
)
_LNP = "lgamma(mm+um+1.0)+lgamma(mu+uu+1.0)+lgamma(mm+mu+1.0)+lgamma(um+uu+1.0)-lgamma(mm+mu+um+uu+1.0)-lgamma({0}+1.0)-lgamma(mm+um-{0}+1.0)-lgamma(mm+mu-{0}+1.0)-lgamma(uu-mm+{0}+1.0)"
_TESTS = (
    _PAIRS
    + f""",
  grid AS (SELECT *, unnest(range(greatest(0, mm - uu), least(mm + mu, mm + um) + 1)) AS i FROM pairs),
  ps AS (SELECT chrom, strand, c1, c2, mm, mu, um, uu, round(least(1.0, sum(CASE WHEN {_LNP.format('i')} <= {_LNP.format('mm')} + {association.TIE}
      THEN exp({_LNP.format('i')}) ELSE 0 END)), 6) AS p FROM grid GROUP BY ALL),
  rk AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS adj FROM ps),
  tests AS (SELECT * EXCLUDE (adj), least(1.0, min(adj) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM rk)"""
)
_TOP = "list_reverse_sort([mm, mu, um, uu])"

SQL = {
    "het_sites_asm": f"WITH {views.SITES} SELECT chrom, pos, strand, context, mc, cov FROM sites WHERE {_BOTH}",
    "het_sites_hap": f"WITH {views.SITES} SELECT chrom, pos, strand, mc, cov FROM sites WHERE {_HET} AND context = 'CG'",
    "split_sites_by_strand": f"""WITH {views.SITES} SELECT chrom, pos, strand, CASE strand WHEN '+' THEN 'C' ELSE 'G' END AS ref,
      CASE strand WHEN '+' THEN 'T' ELSE 'A' END AS alt, 600 AS qual, 'PASS' AS filter_tag, '0/1' AS gt FROM sites WHERE {_HET}""",
    "corrected_ratios": f"""WITH {views.SITES} SELECT chrom, pos, strand, context, round(CASE WHEN rev_ga > 20 AND rev_g > 0
      THEN least(1.0, mc / (cov * (rev_g / rev_ga))) ELSE mc / cov END, 6) AS ratio FROM sites""",
    "meth_category_hist": f"WITH {views.SITES} SELECT context, {_CATEGORY} AS category, count(*) AS n_sites FROM sites GROUP BY ALL",
    "meth_density": f"WITH {views.SITES} SELECT context, least(floor(100 * mc / cov), 99)::BIGINT AS bin, count(*) AS n_sites FROM sites GROUP BY ALL",
    "region_sums": f"""WITH {views.SITES} SELECT chrom, pos // 1000 AS region, strand, context, count(*) AS n_sites, sum(mc)::BIGINT AS mc,
      sum(cov)::BIGINT AS cov FROM sites GROUP BY ALL HAVING count(*) >= 2""",
    "sliding_bins": f"""WITH {views.SITES}, b AS (SELECT chrom, context, (pos // 1000)::BIGINT AS bin, sum(mc)::BIGINT AS m, sum(cov)::BIGINT AS c FROM sites GROUP BY ALL),
      w AS (SELECT chrom, context, bin, sum(m) OVER x AS mc, sum(c) OVER x AS cov FROM b
        WINDOW x AS (PARTITION BY chrom, context ORDER BY bin RANGE BETWEEN 1 PRECEDING AND CURRENT ROW))
      SELECT chrom, context, bin, mc::BIGINT AS mc, cov::BIGINT AS cov FROM w WHERE cov > 10""",
    "strand_context_totals": f"""WITH {views.SITES} SELECT coalesce(strand, 'all') AS strand, coalesce(context, 'all') AS context, sum(mc)::BIGINT AS mc,
      sum(cov)::BIGINT AS cov FROM sites GROUP BY CUBE (strand, context)""",
    "weighted_levels": f"""WITH {views.SITES} SELECT chrom, context, round(avg(mc / cov), 6) AS mean_level, round(sum(mc) / sum(cov), 6) AS weighted_level,
      round(stddev_pop(mc / cov), 6) AS sd_level, round(max(mc / cov), 6) AS max_level, round(min(mc / cov), 6) AS min_level, sum(cov)::BIGINT AS cov
      FROM sites GROUP BY ALL""",
    "zoom_levels": f"""WITH {views.SITES}, z AS (SELECT unnest([1000, 10000, 100000]) AS width)
      SELECT width, chrom, (pos // width * width)::BIGINT AS at, count(*) AS n, sum(mc)::BIGINT AS mc, sum(cov)::BIGINT AS cov FROM sites, z GROUP BY ALL""",
    "drop_bs_ambiguous": """WITH v AS (SELECT *, upper(ref_allele) || upper(alt_allele) AS ra FROM readvariant
      WHERE filter_tag = 'PASS' AND length(ref_allele) = 1 AND length(alt_allele) <= 3)
      SELECT varid, '+' AS strand, chrom, position FROM v WHERE ra NOT IN ('CT', 'TC')
      UNION ALL SELECT varid, '-', chrom, position FROM v WHERE ra NOT IN ('GA', 'AG')""",
    "call_totals": f"""WITH {views.CALLS} SELECT strand, context, count(*) FILTER (methylated) AS methylated, count(*) FILTER (NOT methylated) AS unmethylated
      FROM calls GROUP BY ALL""",
    "site_counts": f"WITH {views.CALLS} SELECT chrom, strand, pos, context, count(*) FILTER (methylated) AS mc, count(*) AS cov FROM calls GROUP BY ALL",
    "next_site_pairs": f"""WITH {views.SITES}, h AS (SELECT DISTINCT chrom, strand, pos::BIGINT AS pos FROM sites WHERE {_BOTH}),
      n AS (SELECT chrom, strand, pos AS c1, lead(pos) OVER (PARTITION BY chrom, strand ORDER BY pos) AS c2 FROM h) SELECT * FROM n WHERE c2 IS NOT NULL""",
    "pair_counts": f"WITH {_PAIRS} SELECT * FROM pairs",
    "pair_tests": f"WITH {_TESTS} SELECT chrom, strand, c1, c2, mm, mu, um, uu, p, round(q, 6) AS q FROM tests",
    "dominance_filter": f"""WITH {_PAIRS}, t AS (SELECT *, {_TOP} AS t FROM pairs) SELECT chrom, strand, c1, c2, round((t[1] + t[2]) / (mm + mu + um + uu), 6) AS share,
      round(CASE WHEN t[2] > 0 THEN ln(t[1] / t[2]) ELSE 0.0 END, 6) AS ratio FROM t""",
    "asm_regions": f"""WITH {_TESTS}, t AS (SELECT *, {_TOP} AS t, mm + mu + um + uu AS n FROM tests WHERE p <= 1.0),
      k AS (SELECT * FROM t WHERE (t[1] + t[2]) / n >= 0.8 AND (t[2] = 0 OR ln(t[1] / t[2]) <= 2.0) AND n BETWEEN 2 AND 1000),
      f AS (SELECT *, CASE WHEN lag(c2) OVER (PARTITION BY chrom, strand ORDER BY c1) = c1 THEN 0 ELSE 1 END AS x FROM k),
      g AS (SELECT *, sum(x) OVER (PARTITION BY chrom, strand ORDER BY c1) AS i FROM f)
      SELECT chrom, strand, min(c1) AS start_pos, max(c2) AS end_pos, 'Meth:' || (max(c2) - min(c1)) AS label, count(*) + 1 AS n_sites
      FROM g GROUP BY chrom, strand, i HAVING count(*) + 1 >= 3""",
    "states_folded": f"""WITH {views.READS}, s AS (SELECT translate(translate(meth_state, 'SI', ''), 'MmXHZUuxhzNnIDacgt', 'MMMMMUUUUU==OOACGT') AS s FROM reads),
      c AS (SELECT unnest(string_split(s, '')) AS state FROM s) SELECT state, count(*) AS n FROM c GROUP BY ALL""",
    "context_classes": """WITH r AS (SELECT ctx5 AS f, reverse(translate(ctx5, 'ACGTacgt', 'TGCAtgca')) AS b FROM methratio WHERE length(ctx5) = 5)
      SELECT CASE WHEN f[3] <> 'C' THEN NULL WHEN f[4] = 'G' THEN 'CG' WHEN f[5] = 'G' THEN 'CHG' ELSE 'CHH' END AS forward,
        CASE WHEN b[3] <> 'C' THEN NULL WHEN b[4] = 'G' THEN 'CG' WHEN b[5] = 'G' THEN 'CHG' ELSE 'CHH' END AS backward, count(*) AS n FROM r GROUP BY ALL""",
}
SQL["asm_regions_strict"] = SQL["asm_regions"].replace("p <= 1.0", "p <= 0.01").replace("n BETWEEN 2 AND", "n BETWEEN 4 AND").replace("+ 1 >= 3", "+ 1 >= 4")
