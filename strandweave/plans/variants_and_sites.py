"""Queries that bring variants, sites and reads together, and confidence filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import reads as fr
from strandweave.operators import association, linkage, rangejoin
from strandweave.operators import sites as st
from strandweave.plans import haplotypes, views
from strandweave.session import read_table

MISMATCH_RATE = 0.06
LEAST_CONFIDENCE = 0.8


def snp_site_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heterozygous sites and usable variants as one list of positions; a position of both is kept once, as a variant."""
    sites = st.heterozygous(views.sites(spark, sf_dir)).select("chrom", F.col("pos").cast("long").alias("pos"), F.lit(1).alias("rank"))
    v = read_table(spark, sf_dir, "readvariant").filter((F.col("filter_tag") == "PASS") & F.col("chrom").isNotNull() & F.col("position").isNotNull())
    both = sites.unionByName(v.select("chrom", F.col("position").cast("long").alias("pos"), F.lit(0).alias("rank")))
    return both.groupBy("chrom", "pos").agg(F.min("rank").alias("rank")).select("chrom", "pos", F.when(F.col("rank") == 0, "variant").otherwise("site").alias("kind"))


def mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union in order: each position's number in its chromosome."""
    return rangejoin.running_total(snp_site_union(spark, sf_dir), ["chrom"], "pos", F.lit(1), "number", 1 << 20)


def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring heterozygous sites cut into segments where no read of the strand covers both."""
    pairs = association.next_site_pairs(st.heterozygous(views.sites(spark, sf_dir)))
    reads = views.reads(spark, sf_dir).select("read_id", "chrom", "strand", "start_pos", "end_pos")
    met = rangejoin.bin_join(pairs, reads, ["chrom", "strand"], "c1", "start_pos", "end_pos").filter(F.col("c2") <= F.col("end_pos"))
    covered = met.groupBy("chrom", "strand", "c1").agg(F.count("*").alias("n_reads"))
    rows = pairs.join(covered, ["chrom", "strand", "c1"], "left").withColumn("n_reads", F.coalesce("n_reads", F.lit(0)))
    return rangejoin.running_total(rows, ["chrom", "strand"], "c1", (F.col("n_reads") == 0).cast("int"), "segment_id", 1 << 18)


def snp_state_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and state pairs of variants with the called sites of the same reads, up to 100 bases apart."""
    v = haplotypes._variants(spark, sf_dir).filter((F.length("ref_allele") == 1) & (F.length(F.substring_index("alt_allele", ",", 1)) == 1))
    points = v.select("chrom", F.col("position").cast("long").alias("vpos"), "varid")
    rows = views.reads(spark, sf_dir, ["cigar", "seq"]).select("read_id", "chrom", "start_pos", "seq", F.explode(fr.aligned_blocks(F.col("cigar"))).alias("b"))
    blocks = rows.select("read_id", "chrom", (F.col("start_pos") + F.col("b.ref_at")).alias("s"), (F.col("start_pos") + F.col("b.ref_at") + F.col("b.len") - 1).alias("e"), F.expr("substring(seq, b.read_at + 1, b.len)").alias("bases"))
    base = F.upper(F.expr("substring(bases, cast(vpos - s as int) + 1, 1)")).alias("base")
    seen = rangejoin.bin_join(points, blocks, ["chrom"], "vpos", "s", "e", 500).select("read_id", "varid", "vpos", base)
    calls = views.base_calls(spark, sf_dir).select("read_id", "pos", F.when(F.col("methylated"), "M").otherwise("U").alias("state"))
    near = seen.join(calls, "read_id").filter((F.col("pos") != F.col("vpos")) & (F.abs(F.col("pos") - F.col("vpos")) <= 100))
    return near.groupBy("varid", "pos", F.concat("base", "state").alias("pair")).agg(F.count("*").alias("n"))


def mismatch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads per library within and beyond the rate of mismatches allowed for their length."""
    rows = read_table(spark, sf_dir, "alignedread").filter(F.col("nm").isNotNull() & F.col("seq").isNotNull())
    keep = F.col("nm") <= 0.5 + MISMATCH_RATE * F.length("seq")
    return rows.groupBy("library_id", keep.alias("kept")).agg(F.count("*").alias("n_reads"), F.sum("nm").alias("mismatches"))


def covered_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per chromosome: heterozygous variants, and those that fragments of two or more calls cover."""
    calls = views.calls(spark, sf_dir)
    long = calls.groupBy("frag_id").agg(F.count("*").alias("n")).filter("n >= 2")
    seen = calls.join(long, "frag_id", "left_semi").select("varid").distinct().withColumn("seen", F.lit(True))
    het = haplotypes._variants(spark, sf_dir).filter(F.col("gt").isin("0/1", "1/0", "0|1", "1|0"))
    return het.join(seen, "varid", "left").groupBy("chrom").agg(F.count("*").alias("n_het"), F.count("seen").alias("n_covered"))


def prune_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phased blocks without the variants of low confidence; a pruned variant splits its block."""
    hap = haplotypes.phase_blocks(spark, sf_dir)
    low = F.col("confidence") < LEAST_CONFIDENCE
    parts = rangejoin.running_total(hap, ["block_id"], "varid", low.cast("int"), "part", 1 << 16)
    return parts.filter(~low).select("block_id", "part", "varid", "hap")


def heterozygous_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of sites that are not heterozygous, cut at each heterozygous one: per chromosome and run, sites and calls."""
    rows = views.sites(spark, sf_dir).filter(F.col("context") == "CG")
    share = F.col("mc") / F.col("cov")
    het = ((share >= 0.1) & (share <= 0.9) & (F.col("cov") >= 6)).cast("int")
    marked = rows.withColumn("_het", het)
    runs = rangejoin.running_total(marked, ["chrom", "strand"], "pos", F.col("_het"), "run_id", 1 << 18).filter("_het = 0")
    return runs.groupBy("chrom", "strand", "run_id").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("n_sites"), F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))


def _pileup(spark: SparkSession, sf_dir: str, least_depth: int) -> DataFrame:
    rows = views.reads(spark, sf_dir, ["cigar", "seq"]).select("chrom", "start_pos", "seq", F.explode(fr.aligned_blocks(F.col("cigar"))).alias("b"))
    return linkage.pileup(rows.select("chrom", (F.col("start_pos") + F.col("b.ref_at")).alias("s"), F.expr("substring(seq, b.read_at + 1, b.len)").alias("bases")), least_depth)


def pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of positions that two reads or more cover with an aligned base."""
    return _pileup(spark, sf_dir, 2)


def pileup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every covered position."""
    return _pileup(spark, sf_dir, 1)


def variant_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.linkage(views.calls(spark, sf_dir)).withColumn("r2", F.round("r2", 6))


def distant_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of fragments of distant mates: frag_id, isize, second (of the second mate), varid, allele and qv."""
    return (
        read_table(spark, sf_dir, "hapfragments")
        .filter((F.col("dtype") == 1) & (F.col("mate2_ix") >= 0) & F.col("frag_id").isNotNull())
        .select("frag_id", "mate2_ix", "isize", F.explode("alist").alias("c"))
        .filter(F.col("c.allele").isin("0", "1") & F.col("c.varid").isNotNull() & F.col("c.qv").isNotNull())
        .select("frag_id", "isize", (F.col("c.varid") >= F.col("mate2_ix")).alias("second"), "c.varid", F.col("c.allele").cast("int").alias("allele"), "c.qv")
        .distinct()
    )


def trans_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of distant mates on different haplotypes, per insert-size bin, under the haplotype of the genotype text."""
    return linkage.trans_rates(distant_calls(spark, sf_dir), haplotypes._fixed(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


QUERIES = {
    f.__name__: f
    for f in (
        snp_site_union, mixed_order, segment_ids, snp_state_pairs, mismatch_filter, covered_variants, prune_confidence, heterozygous_cuts,
        pileup, pileup_all, variant_linkage, trans_rates,
    )
}

_HET = "mc >= 2 AND cov >= 6 AND mc / cov >= 0.1 AND mc / cov <= 0.9 AND mc > 2 AND cov - mc > 2"
_UNION = f"""{views.SITES}, u AS (SELECT chrom, pos, CASE min(k) WHEN 0 THEN 'variant' ELSE 'site' END AS kind FROM
    (SELECT chrom, pos::BIGINT AS pos, 1 AS k FROM sites WHERE {_HET} UNION ALL
     SELECT chrom, position, 0 FROM readvariant WHERE filter_tag = 'PASS' AND chrom IS NOT NULL AND position IS NOT NULL) GROUP BY chrom, pos)"""

SQL = {
    "snp_site_union": f"WITH {_UNION} SELECT chrom, pos, kind FROM u",
    "mixed_order": f"WITH {_UNION} SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS number FROM u",
    "segment_ids": f"""WITH {views.READS}, {views.SITES}, h AS (SELECT DISTINCT chrom, strand, pos::BIGINT AS pos FROM sites WHERE {_HET}),
      n AS (SELECT chrom, strand, pos AS c1, lead(pos) OVER (PARTITION BY chrom, strand ORDER BY pos) AS c2 FROM h),
      c AS (SELECT n.chrom, n.strand, c1, c2, count(read_id) AS n_reads FROM n LEFT JOIN reads r ON r.chrom = n.chrom AND r.strand = n.strand
        AND c1 >= start_pos AND c2 <= end_pos WHERE c2 IS NOT NULL GROUP BY ALL)
      SELECT *, sum(CASE WHEN n_reads = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY c1)::BIGINT AS segment_id FROM c""",
    "snp_state_pairs": f"""WITH {views.CALLS}, v AS (SELECT chrom, position AS vpos, varid FROM readvariant WHERE varid IS NOT NULL AND chrom IS NOT NULL
        AND position IS NOT NULL AND length(ref_allele) = 1 AND length(split_part(alt_allele, ',', 1)) = 1),
      sb AS (SELECT read_id, seq FROM reads),
      b AS (SELECT blk.read_id, blk.chrom, start_pos + ref_at AS s, len, upper(seq[read_at + 1 : read_at + len]) AS bases FROM blk JOIN sb ON sb.read_id = blk.read_id WHERE op = 'M'),
      m AS (SELECT read_id, varid, vpos, bases[vpos - s + 1] AS base FROM v JOIN b ON b.chrom = v.chrom AND vpos BETWEEN s AND s + len - 1)
      SELECT varid, pos, base || CASE WHEN methylated THEN 'M' ELSE 'U' END AS pair, count(*) AS n FROM m JOIN calls c ON c.read_id = m.read_id
      WHERE pos <> vpos AND abs(pos - vpos) <= 100 GROUP BY ALL""",
    "mismatch_filter": f"""SELECT library_id, nm <= 0.5 + {MISMATCH_RATE} * length(seq) AS kept, count(*) AS n_reads, sum(nm)::BIGINT AS mismatches FROM alignedread
      WHERE nm IS NOT NULL AND seq IS NOT NULL GROUP BY ALL""",
    "covered_variants": f"""WITH {views.FRAGMENT_CALLS}, l AS (SELECT frag_id FROM calls GROUP BY 1 HAVING count(*) >= 2),
      s AS (SELECT DISTINCT varid FROM calls WHERE frag_id IN (SELECT frag_id FROM l))
      SELECT chrom, count(*) AS n_het, count(s.varid) AS n_covered FROM readvariant v LEFT JOIN s ON s.varid = v.varid
      WHERE gt IN ('0/1', '1/0', '0|1', '1|0') AND v.varid IS NOT NULL AND chrom IS NOT NULL AND position IS NOT NULL GROUP BY chrom""",
    "heterozygous_cuts": f"""WITH {views.SITES}, x AS (SELECT *, CASE WHEN mc / cov >= 0.1 AND mc / cov <= 0.9 AND cov >= 6 THEN 1 ELSE 0 END AS h FROM sites WHERE context = 'CG'),
      r AS (SELECT *, sum(h) OVER (PARTITION BY chrom, strand ORDER BY pos)::BIGINT AS run_id FROM x)
      SELECT chrom, strand, run_id, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_sites, sum(mc)::BIGINT AS mc, sum(cov)::BIGINT AS cov
      FROM r WHERE h = 0 GROUP BY chrom, strand, run_id""",
    "pileup": f"""WITH {views.CALLS}, sb AS (SELECT read_id, seq FROM reads),
      b AS (SELECT blk.chrom, start_pos + ref_at AS s, upper(seq[read_at + 1 : read_at + len]) AS bases FROM blk
          JOIN sb ON sb.read_id = blk.read_id WHERE op = 'M'),
      c AS (SELECT chrom, s, bases, unnest(range(length(bases))) AS i FROM b), d AS (SELECT chrom, s + i AS pos, bases[i + 1] AS x FROM c)
      SELECT chrom, pos, count(*) AS depth, count(*) FILTER (x = 'A') AS a, count(*) FILTER (x = 'C') AS c, count(*) FILTER (x = 'G') AS g,
        count(*) FILTER (x = 'T') AS t FROM d GROUP BY chrom, pos HAVING count(*) >= 2""",
    "trans_rates": f"""WITH RECURSIVE h AS (SELECT varid, CASE WHEN starts_with(gt, '1') THEN 1 ELSE 0 END AS hap FROM readvariant
        WHERE varid IS NOT NULL AND chrom IS NOT NULL AND position IS NOT NULL),
      c AS (SELECT frag_id, mate2_ix, isize, unnest(alist) AS c FROM hapfragments WHERE dtype = 1 AND mate2_ix >= 0 AND frag_id IS NOT NULL),
      k AS (SELECT DISTINCT frag_id, isize, c.varid >= mate2_ix AS second, c.varid AS varid, c.allele::INT AS allele, c.qv AS qv FROM c
        WHERE c.allele IN ('0', '1') AND c.varid IS NOT NULL AND c.qv IS NOT NULL),
      r AS (SELECT frag_id, second, isize, allele = hap AS fit, pow(10.0, -qv / 10.0) AS e FROM k JOIN h ON h.varid = k.varid WHERE qv >= 6),
      m AS (SELECT frag_id, second, max(isize) AS isize, sum(log10(CASE WHEN fit THEN 1 - e ELSE e END)) AS x, sum(log10(CASE WHEN fit THEN e ELSE 1 - e END)) AS y FROM r GROUP BY ALL),
      b AS (SELECT a.isize, a.x AS a1, a.y AS a2, d.x AS b1, d.y AS b2 FROM m a JOIN m d ON a.frag_id = d.frag_id AND NOT a.second AND d.second WHERE a.isize IS NOT NULL),
      l AS (SELECT isize, {haplotypes._LOG_SUM.format('a1 + b1', 'a2 + b2')} AS cis, {haplotypes._LOG_SUM.format('a1 + b2', 'a2 + b1')} AS trans FROM b),
      t AS (SELECT (abs(isize) // 5000)::BIGINT AS bin, round(1 / (1 + pow(10.0, least(cis - trans, 300.0))), 4) AS t, count(*) AS n FROM l GROUP BY ALL),
      w AS (SELECT bin, sum(n)::BIGINT AS n, list({{'t': t, 'n': n}}) AS w FROM t GROUP BY bin),
      s AS (SELECT bin, n, w, 0 AS i, 1e-4 AS lo, 1 - 1e-4 AS hi FROM w UNION ALL
        SELECT bin, n, w, i + 1, CASE WHEN z > 0 THEN mid ELSE lo END, CASE WHEN z > 0 THEN hi ELSE mid END FROM (SELECT *, (lo + hi) / 2 AS mid,
          list_sum(list_transform(w, lambda q: q.n * (2 * q.t - 1) / ((lo + hi) / 2 * q.t + (1 - (lo + hi) / 2) * (1 - q.t)))) AS z FROM s WHERE i < 40))
      SELECT bin, n, round((lo + hi) / 2, 6) AS rate FROM s WHERE i = 40""",
    "variant_linkage": f"""WITH {views.FRAGMENT_CALLS}, x AS (SELECT varid AS a, lead(varid) OVER w AS b, allele AS x, lead(allele) OVER w AS y FROM calls WINDOW w AS (PARTITION BY frag_id ORDER BY varid)),
      t AS (SELECT a, b, count(*) AS n, avg(x) AS p, avg(y) AS q, avg(x * y) AS pq FROM x WHERE b IS NOT NULL GROUP BY a, b)
      SELECT a, b, n, CASE WHEN p * (1 - p) * q * (1 - q) > 1e-12 THEN round((pq - p * q) * (pq - p * q) / (p * (1 - p) * q * (1 - q)), 6) END AS r2 FROM t""",
}
SQL["pileup_all"] = SQL["pileup"].replace("HAVING count(*) >= 2", "")
