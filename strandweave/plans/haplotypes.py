"""Queries over variants and haplotype fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import reads as fr
from strandweave.operators import fragments as fg
from strandweave.operators.rangejoin import bin_join
from strandweave.plans import views
from strandweave.session import cut_lineage, read_table


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "readvariant").filter(F.col("varid").isNotNull() & F.col("chrom").isNotNull() & F.col("position").isNotNull())


def variant_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class of genotype, type and strand label: usable variants."""
    gt = F.regexp_replace("gt", r"\|", "/")
    kind = F.when(gt.isin("0/1", "1/0"), "1").when(gt.isin("0/2", "2/0", "1/2", "2/1"), "2").when(gt.isin("0/0", "1/1"), "0")
    pair = F.upper(F.concat("ref_allele", "alt_allele"))
    label = F.when(pair.isin("CT", "TC", "GA", "AG"), "METH").otherwise("SNV")
    size = F.when(F.length("ref_allele") == F.length(F.substring_index("alt_allele", ",", 1)), "snv").otherwise("indel")
    return _variants(spark, sf_dir).filter(F.col("filter_tag") == "PASS").groupBy(kind.alias("het_class"), size.alias("kind"), label.alias("label")).agg(F.count("*").alias("n"))


def natural_variant_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants numbered within the version order of their chromosomes: the rank of each chromosome, by name."""
    chroms = _variants(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n_variants"), F.min("position").alias("first_position"))
    rank = F.row_number().over(Window.orderBy(*[k.asc_nulls_first() for k in fr.natural_order(F.col("chrom"))]))
    return chroms.withColumn("chrom_rank", rank)


def variants_in_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles of reads at single-base variants, through their aligned runs: counts per variant and allele."""
    v = _variants(spark, sf_dir).filter((F.length("ref_allele") == 1) & (F.length(F.substring_index("alt_allele", ",", 1)) == 1))
    points = v.select("chrom", F.col("position").cast("long").alias("pos"), "varid", F.upper("ref_allele").alias("ref"), F.upper(F.substring_index("alt_allele", ",", 1)).alias("alt"))
    rows = views.reads(spark, sf_dir, ["cigar", "seq"]).select("read_id", "chrom", "start_pos", "seq", F.explode(fr.aligned_blocks(F.col("cigar"))).alias("b"))
    blocks = rows.select("read_id", "chrom", (F.col("start_pos") + F.col("b.ref_at")).alias("s"), (F.col("start_pos") + F.col("b.ref_at") + F.col("b.len") - 1).alias("e"), F.expr("substring(seq, b.read_at + 1, b.len)").alias("bases"))
    base = F.upper(F.expr("substring(bases, cast(pos - s as int) + 1, 1)"))
    allele = F.when(base == F.col("ref"), 0).when(base == F.col("alt"), 1)
    met = bin_join(points, blocks, ["chrom"], "pos", "s", "e", 500)
    return met.groupBy("varid").agg(F.count_if(allele == 0).alias("n_ref"), F.count_if(allele == 1).alias("n_alt"), F.count_if(allele.isNull()).alias("n_other"))


def variant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per read, how many variants it covers and the first of them; reads that cover none are left out."""
    points = _variants(spark, sf_dir).select("chrom", F.col("position").cast("long").alias("pos"), "varid")
    met = bin_join(points, views.reads(spark, sf_dir).select("read_id", "chrom", "start_pos", "end_pos"), ["chrom"], "pos", "start_pos", "end_pos", 500)
    return met.groupBy("read_id").agg(F.count("*").alias("n_variants"), F.min("varid").alias("first_varid"))


def mate_merge_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.calls(spark, sf_dir)


def barcode_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls joined over the fragments of one library that start at the same variant, as reads of one molecule."""
    rows = (
        read_table(spark, sf_dir, "hapfragments")
        .filter((F.col("dtype") == 2) & F.col("varid").isNotNull() & F.col("library_id").isNotNull())
        .select(F.concat_ws(":", "library_id", F.col("varid").cast("string")).alias("mol_id"), F.explode("alist").alias("c"))
        .filter(F.col("c.allele").isin("0", "1") & F.col("c.varid").isNotNull() & F.col("c.qv").isNotNull())
        .select("mol_id", "c.varid", F.col("c.allele").cast("int").alias("allele"), "c.qv")
    )
    return fg.link_barcodes(rows)


def fragment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fg.fragment_runs(views.calls(spark, sf_dir))


def variant_edges_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fg.path_edges(views.calls(spark, sf_dir))


def variant_edges_clique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fg.clique_edges(views.calls(spark, sf_dir))


def allele_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fg.allele_depth(views.calls(spark, sf_dir))


def mean_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean variants per fragment of two or more, and whether edges of long reads are called for (three or more)."""
    per = views.calls(spark, sf_dir).groupBy("frag_id").agg(F.count("*").alias("n")).filter("n >= 2")
    return per.agg(F.count("*").alias("n_fragments"), F.round(F.avg("n"), 6).alias("mean_calls"), (F.avg("n") >= 3).alias("long_reads"))


def spanning_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fg.spanning_blocks(views.calls(spark, sf_dir))


def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cut_lineage(views.calls(spark, sf_dir))
    return fg.block_summary(cut_lineage(fg.spanning_blocks(calls)), _variants(spark, sf_dir), calls)


def block_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fg.half_length(block_summary(spark, sf_dir).filter(F.col("span") > 0), "span")


def chain_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cut_lineage(views.calls(spark, sf_dir))
    return fg.chain_phase(calls, cut_lineage(fg.spanning_blocks(calls)))


def phase_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes after local search, with the confidence of each variant."""
    calls = cut_lineage(views.calls(spark, sf_dir))
    return fg.phase(calls, cut_lineage(fg.spanning_blocks(calls))).withColumn("confidence", F.round("confidence", 6))


LEAST_POSTERIOR = 0.8


def refined_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes at a maximum of the likelihood, with each variant's posterior; those below 0.8 are ``pruned``."""
    calls = cut_lineage(views.calls(spark, sf_dir))
    hap = fg.refine(calls, fg.phase(calls, cut_lineage(fg.spanning_blocks(calls))))
    return hap.withColumn("posterior", F.round("posterior", 6)).withColumn("pruned", F.col("posterior") < LEAST_POSTERIOR)


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given haplotype: that of the genotype text, first allele."""
    return _variants(spark, sf_dir).select("varid", F.when(F.col("gt").startswith("1"), 1).otherwise(0).alias("hap"))


def fragment_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fg.log_likelihood(views.calls(spark, sf_dir), _fixed(spark, sf_dir)).withColumn("ll", F.round("ll", 6) + 0.0)


def discrete_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fg.support(views.calls(spark, sf_dir), _fixed(spark, sf_dir))


def flip_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What flipping each variant adds to the likelihood of the fragments, and the posterior of its given phase."""
    gains = fg.flip_gains(cut_lineage(views.calls(spark, sf_dir)), _fixed(spark, sf_dir))
    return gains.select("varid", (F.round("gain", 4) + 0.0).alias("gain"), F.round("posterior", 4).alias("posterior"))


def switch_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What flipping a block from each variant on adds to the likelihood of the fragments."""
    calls = cut_lineage(views.calls(spark, sf_dir))
    hap = fg.spanning_blocks(calls).join(_fixed(spark, sf_dir), "varid")
    return fg.switch_gains(calls, cut_lineage(hap)).withColumn("gain", F.round("gain", 4) + 0.0)


def block_an50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N50 of the blocks' spans, each reduced to the share of its variants that are phased."""
    spans = block_summary(spark, sf_dir).select(F.floor(F.col("span") * F.col("phased") / F.col("len")).alias("span"))
    return fg.half_length(spans, "span").withColumnRenamed("n50", "an50")


def switch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chained haplotype against that of the genotype text."""
    hap = cut_lineage(chain_phase(spark, sf_dir))
    return fg.switch_errors(hap, _fixed(spark, sf_dir).withColumnRenamed("hap", "true_hap"))


QUERIES = {
    f.__name__: f
    for f in (
        variant_classes, natural_variant_order, variants_in_reads, variant_lookup, mate_merge_calls, barcode_molecules, fragment_runs,
        variant_edges_path, variant_edges_clique, allele_depth, mean_calls, spanning_blocks, block_summary, block_n50, chain_phase,
        phase_blocks, refined_blocks, fragment_loglik, discrete_prune, flip_posteriors, switch_gains, block_an50, switch_errors,
    )
}

_V = "v AS (SELECT * FROM readvariant WHERE varid IS NOT NULL AND chrom IS NOT NULL AND position IS NOT NULL)"
_EDGES = """nx AS (SELECT frag_id, varid AS a, allele, lead(varid) OVER w AS b, lead(allele) OVER w AS nxt FROM calls WINDOW w AS (PARTITION BY frag_id ORDER BY varid)),
  edges AS (SELECT a, b, count(*) FILTER (allele = nxt) AS same, count(*) FILTER (allele <> nxt) AS other FROM nx WHERE b IS NOT NULL GROUP BY a, b)"""
_BLOCKS = """sp AS (SELECT frag_id, min(varid) AS s, max(varid) AS e FROM calls GROUP BY frag_id HAVING min(varid) < max(varid)),
  hd AS (SELECT s FROM (SELECT s, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sp) WHERE b IS NULL OR s > b),
  blocks AS (SELECT varid, (SELECT max(s) FROM hd WHERE s <= varid) AS block_id FROM (SELECT DISTINCT varid FROM calls JOIN sp ON calls.frag_id = sp.frag_id))"""
_SUMMARY = """shape AS (SELECT block_id, max(b.varid) - min(b.varid) + 1 AS len, count(*) AS phased, max(position) - min(position) AS span
    FROM blocks b LEFT JOIN v ON v.varid = b.varid GROUP BY block_id),
  fr AS (SELECT block_id, count(*) AS n FROM (SELECT frag_id, block_id FROM calls JOIN blocks ON calls.varid = blocks.varid GROUP BY ALL HAVING count(*) > 1) GROUP BY block_id),
  summary AS (SELECT shape.block_id, len, phased, span, coalesce(n, 0) AS fragments FROM shape LEFT JOIN fr ON fr.block_id = shape.block_id)"""
_CHAIN = """od AS (SELECT varid, block_id, lag(varid) OVER (PARTITION BY block_id ORDER BY varid) AS prev FROM blocks),
  chain AS (SELECT varid, block_id, (sum(CASE WHEN other > same THEN 1 ELSE 0 END) OVER (PARTITION BY block_id ORDER BY varid) % 2)::INT AS hap
    FROM od LEFT JOIN edges ON a = prev AND b = varid)"""
_FIXED = "h AS (SELECT varid, CASE WHEN starts_with(gt, '1') THEN 1 ELSE 0 END AS hap FROM v)"

_LIKELIHOODS = """h AS (SELECT varid, CASE WHEN starts_with(gt, '1') THEN 1 ELSE 0 END AS hap FROM v),
  r AS (SELECT frag_id, calls.varid, allele = hap AS fit, pow(10.0, -qv / 10.0) AS e FROM calls JOIN h ON h.varid = calls.varid WHERE qv >= 6),
  sd AS (SELECT *, CASE WHEN fit THEN log10(e / (1 - e)) ELSE -log10(e / (1 - e)) END AS d,
    sum(log10(CASE WHEN fit THEN 1 - e ELSE e END)) OVER (PARTITION BY frag_id) AS x, sum(log10(CASE WHEN fit THEN e ELSE 1 - e END)) OVER (PARTITION BY frag_id) AS y FROM r)"""
_LOG_SUM = "(greatest({0}, {1}) + log10(1 + pow(10.0, -abs(({0}) - ({1})))))"

SQL = {
    "variant_classes": f"""WITH {_V}, c AS (SELECT replace(gt, '|', '/') AS g, length(ref_allele) = length(split_part(alt_allele, ',', 1)) AS eq,
      upper(ref_allele || alt_allele) IN ('CT', 'TC', 'GA', 'AG') AS bs FROM v WHERE filter_tag = 'PASS')
      SELECT CASE WHEN g IN ('0/1', '1/0') THEN '1' WHEN g IN ('0/2', '2/0', '1/2', '2/1') THEN '2' WHEN g IN ('0/0', '1/1') THEN '0' END AS het_class,
        CASE WHEN eq THEN 'snv' ELSE 'indel' END AS kind, CASE WHEN bs THEN 'METH' ELSE 'SNV' END AS label, count(*) AS n FROM c GROUP BY ALL""",
    "natural_variant_order": f"""WITH {_V}, c AS (SELECT chrom, count(*) AS n_variants, min(position) AS first_position FROM v GROUP BY chrom)
      SELECT *, row_number() OVER (ORDER BY regexp_extract(chrom, '^([^0-9]*)', 1), try_cast(regexp_extract(chrom, '^[^0-9]*([0-9]*)', 1) AS BIGINT) NULLS FIRST,
        regexp_extract(chrom, '^[^0-9]*[0-9]*(.*)$', 1))::INT AS chrom_rank FROM c""",
    "variants_in_reads": f"""WITH {_V}, {views.CALLS.replace('meth_state', 'seq').split('chars AS')[0].rstrip().rstrip(',')},
      p AS (SELECT varid, chrom, position, upper(ref_allele) AS ref, upper(split_part(alt_allele, ',', 1)) AS alt FROM v
        WHERE length(ref_allele) = 1 AND length(split_part(alt_allele, ',', 1)) = 1),
      m AS (SELECT varid, ref, alt, upper(s[position - a0 + 1]) AS b FROM p JOIN run ON run.chrom = p.chrom AND position BETWEEN a0 AND a0 + length(s) - 1)
      SELECT varid, count(*) FILTER (b = ref) AS n_ref, count(*) FILTER (b <> ref AND b = alt) AS n_alt, count(*) FILTER (b <> ref AND b <> alt) AS n_other FROM m GROUP BY varid""",
    "variant_lookup": f"""WITH {_V}, {views.READS} SELECT read_id, count(*) AS n_variants, min(varid) AS first_varid FROM reads JOIN v
      ON v.chrom = reads.chrom AND v.position BETWEEN start_pos AND end_pos GROUP BY read_id""",
    "mate_merge_calls": f"WITH {views.FRAGMENT_CALLS} SELECT frag_id, varid, allele, qv FROM calls",
    "barcode_molecules": """WITH c AS (SELECT library_id || ':' || varid AS mol_id, unnest(alist) AS c FROM hapfragments
        WHERE dtype = 2 AND varid IS NOT NULL AND library_id IS NOT NULL)
      SELECT mol_id, c.varid AS varid, min(c.allele::INT) AS allele, least(sum(c.qv), 93)::BIGINT AS qv FROM c
      WHERE c.allele IN ('0', '1') AND c.varid IS NOT NULL AND c.qv IS NOT NULL GROUP BY mol_id, c.varid HAVING min(c.allele) = max(c.allele)""",
    "fragment_runs": f"""WITH {views.FRAGMENT_CALLS}, i AS (SELECT *, varid - row_number() OVER (PARTITION BY frag_id ORDER BY varid) AS r FROM calls),
      g AS (SELECT frag_id, r, min(varid) || ' ' || string_agg(allele::VARCHAR, '' ORDER BY varid) AS t, string_agg(chr(least(qv, 93) + 33), '' ORDER BY varid) AS q,
        min(varid) AS s FROM i GROUP BY frag_id, r)
      SELECT frag_id, count(*)::INT AS n_blocks, string_agg(t, ' ' ORDER BY s) AS runs, string_agg(q, '' ORDER BY s) AS quals FROM g GROUP BY frag_id""",
    "variant_edges_path": f"WITH {views.FRAGMENT_CALLS}, {_EDGES} SELECT * FROM edges",
    "variant_edges_clique": f"""WITH {views.FRAGMENT_CALLS} SELECT x.varid AS a, y.varid AS b, count(*) FILTER (x.allele = y.allele) AS same,
      count(*) FILTER (x.allele <> y.allele) AS other FROM calls x JOIN calls y ON x.frag_id = y.frag_id AND x.varid < y.varid GROUP BY ALL""",
    "allele_depth": f"""WITH {views.FRAGMENT_CALLS} SELECT varid, count(*) FILTER (allele = 0) AS n0, count(*) FILTER (allele = 1) AS n1, sum(qv)::BIGINT AS qv
      FROM calls GROUP BY varid""",
    "mean_calls": f"""WITH {views.FRAGMENT_CALLS}, n AS (SELECT count(*) AS n FROM calls GROUP BY frag_id HAVING count(*) >= 2)
      SELECT count(*) AS n_fragments, round(avg(n), 6) AS mean_calls, avg(n) >= 3 AS long_reads FROM n""",
    "spanning_blocks": f"WITH {views.FRAGMENT_CALLS}, {_BLOCKS} SELECT varid, block_id FROM blocks",
    "block_summary": f"WITH {_V}, {views.FRAGMENT_CALLS}, {_BLOCKS}, {_SUMMARY} SELECT * FROM summary",
    "block_n50": f"""WITH {_V}, {views.FRAGMENT_CALLS}, {_BLOCKS}, {_SUMMARY}, t AS (SELECT span, sum(span) OVER (ORDER BY span DESC) AS t, sum(span) OVER () AS a FROM summary WHERE span > 0)
      SELECT max(span) AS n50 FROM t WHERE t >= a / 2""",
    "chain_phase": f"WITH {views.FRAGMENT_CALLS}, {_EDGES}, {_BLOCKS}, {_CHAIN} SELECT varid, block_id, hap FROM chain",
    "fragment_loglik": f"""WITH {_V}, {views.FRAGMENT_CALLS}, {_FIXED}, r AS (SELECT frag_id, allele = hap AS fit, pow(10.0, -qv / 10.0) AS e FROM calls JOIN h ON h.varid = calls.varid WHERE qv >= 6),
      s AS (SELECT frag_id, sum(log10(CASE WHEN fit THEN 1 - e ELSE e END)) AS x, sum(log10(CASE WHEN fit THEN e ELSE 1 - e END)) AS y FROM r GROUP BY frag_id)
      SELECT frag_id, round(greatest(x, y) + log10(pow(10.0, x - greatest(x, y)) + pow(10.0, y - greatest(x, y))), 6) + 0.0 AS ll FROM s""",
    "flip_posteriors": f"""WITH {_V}, {views.FRAGMENT_CALLS}, {_LIKELIHOODS}, g AS (SELECT varid, sum({_LOG_SUM.format('x + d', 'y - d')} - {_LOG_SUM.format('x', 'y')}) AS gain
      FROM sd GROUP BY varid) SELECT varid, round(gain, 4) + 0.0 AS gain, round(1 / (1 + pow(10.0, least(gain, 300.0))), 4) AS posterior FROM g""",
    "switch_gains": f"""WITH {_V}, {views.FRAGMENT_CALLS}, {_BLOCKS}, {_LIKELIHOODS},
      nx AS (SELECT *, lead(varid) OVER w AS nxt, sum(d) OVER (PARTITION BY frag_id ORDER BY varid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z
        FROM sd WINDOW w AS (PARTITION BY frag_id ORDER BY varid)),
      cuts AS (SELECT varid, nxt, {_LOG_SUM.format('x + z', 'y - z')} - {_LOG_SUM.format('x', 'y')} AS g FROM nx WHERE nxt IS NOT NULL)
      SELECT b.block_id, b.varid, round(coalesce(sum(g), 0.0), 4) + 0.0 AS gain FROM blocks b JOIN h ON h.varid = b.varid
      LEFT JOIN cuts c ON c.varid < b.varid AND b.varid <= c.nxt GROUP BY b.block_id, b.varid""",
    "block_an50": f"""WITH {_V}, {views.FRAGMENT_CALLS}, {_BLOCKS}, {_SUMMARY}, s AS (SELECT floor(span * phased / len)::BIGINT AS span FROM summary),
      t AS (SELECT span, sum(span) OVER (ORDER BY span DESC) AS t, sum(span) OVER () AS a FROM s WHERE span > 0) SELECT max(span) AS an50 FROM t WHERE t >= a / 2""",
    "switch_errors": f"""WITH {_V}, {views.FRAGMENT_CALLS}, {_EDGES}, {_BLOCKS}, {_CHAIN}, {_FIXED},
      x AS (SELECT block_id, chain.varid, CASE WHEN chain.hap <> h.hap THEN 1 ELSE 0 END AS x FROM chain JOIN h ON h.varid = chain.varid),
      c AS (SELECT *, CASE WHEN x <> lag(x) OVER w THEN 1 ELSE 0 END AS c, lead(x) OVER w IS NULL AS l FROM x WINDOW w AS (PARTITION BY block_id ORDER BY varid)),
      r AS (SELECT *, sum(1 - c) OVER (PARTITION BY block_id ORDER BY varid) AS r FROM c),
      n AS (SELECT block_id, r, count(*) AS n, bool_or(l) AS l FROM r WHERE c = 1 GROUP BY block_id, r),
      p AS (SELECT block_id, sum(CASE WHEN l THEN 0 ELSE n % 2 END)::BIGINT AS s, sum(n // 2 + CASE WHEN l THEN n % 2 ELSE 0 END)::BIGINT AS m FROM n GROUP BY block_id)
      SELECT x.block_id, count(*) AS compared, coalesce(any_value(s), 0) AS switches, coalesce(any_value(m), 0) AS mismatches FROM x LEFT JOIN p ON p.block_id = x.block_id GROUP BY x.block_id""",
    "discrete_prune": f"""WITH {_V}, {views.FRAGMENT_CALLS}, {_FIXED}, r AS (SELECT frag_id, calls.varid, CASE WHEN allele = hap THEN 1 ELSE -1 END AS f FROM calls JOIN h ON h.varid = calls.varid),
      s AS (SELECT *, sum(f) OVER (PARTITION BY frag_id) AS side FROM r)
      SELECT varid, count(*) FILTER (f * side > 0) AS n_for, count(*) FILTER (f * side < 0) AS n_against,
        count(*) FILTER (f * side > 0) = count(*) FILTER (f * side < 0) AS pruned FROM s WHERE side <> 0 GROUP BY varid""",
}
