"""Queries for the evidence of reads at variants and sites: admission, qualities, alleles, contingency tables and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import reads as fr
from strandweave.operators import association, linkage, rangejoin
from strandweave.operators import fragments as fg
from strandweave.operators import sites as st
from strandweave.plans import alignments, haplotypes, methylation, variants_and_sites, views
from strandweave.session import cut_lineage, read_table

LEAST_BASE_QUALITY = 13
MOST_INSERT = 1000
MOST_DISTANCE = 40_000_000
MOST_P = 0.01
LEAST_DEPTH = 5


def het_sites_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heterozygous sites where the source has a level and a depth: the calls are their rounded product."""
    raw = read_table(spark, sf_dir, "methratio").filter((F.col("pos") > 0) & F.col("strand").isin("+", "-") & (F.col("coverage") > 0) & F.col("methlevel").between(0.0, 1.0))
    mc = F.floor(F.col("methlevel") * F.col("coverage") + 0.5)
    return st.heterozygous(raw.select("row_id", "pos", "strand", mc.alias("mc"), F.col("coverage").alias("cov")), ratio=0.1)


def mate_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of pairs by the strand that mate number and orientation give, proper pair or not; others have none."""
    flag = F.col("flag")
    plus, minus = fr.has(flag, 96) | fr.has(flag, 144), fr.has(flag, 80) | fr.has(flag, 160)
    return read_table(spark, sf_dir, "alignedread").groupBy(F.when(plus, "+").when(minus, "-").alias("strand")).agg(F.count("*").alias("n_reads"))


def proper_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary reads that pass the filters of their source: pairs within the insert size, single ones beyond it."""
    flag, size = F.col("flag"), F.abs(F.col("insert_size"))
    rows = read_table(spark, sf_dir, "alignedread").filter(fr.has(flag, 0x2) & (flag.bitwiseAND(0x100 | 0x200 | 0x800) == 0) & (F.col("mate_chrom").isin("=") | (F.col("mate_chrom") == F.col("chrom"))))
    return rows.groupBy("library_id", F.when(size <= MOST_INSERT, "paired").otherwise("single").alias("kind")).agg(F.count("*").alias("n_reads"))


def marked_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of reads with the mark of a duplicate for all but the kept read of each place."""
    kept = alignments.dedup_reads(spark, sf_dir).select(F.col("read_id").alias("_r"))
    rows = views.reads(spark, sf_dir).filter(F.col("strand").isNotNull()).join(kept, F.col("read_id") == F.col("_r"), "left")
    return rows.select("read_id", F.when(F.col("_r").isNull(), F.col("flag").bitwiseOR(1024)).otherwise(F.col("flag")).alias("flag"))


def admitted_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that cover two heterozygous sites of their strand or more."""
    points = st.heterozygous(views.sites(spark, sf_dir)).select("chrom", "strand", F.col("pos").cast("long").alias("pos")).distinct()
    rows = views.reads(spark, sf_dir).select("read_id", "chrom", "strand", "start_pos", "end_pos")
    met = rangejoin.bin_join(points, rows, ["chrom", "strand"], "pos", "start_pos", "end_pos")
    return met.groupBy("read_id").agg(F.count("*").alias("n_sites")).filter("n_sites >= 2")


def mate_site_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring sites that a pair of mates covers, each by either mate: sites in the gap between mates do not count."""
    sites = st.heterozygous(views.sites(spark, sf_dir))
    pairs = association.next_site_pairs(sites)
    points = sites.select("chrom", "strand", F.col("pos").cast("long").alias("pos")).distinct()
    rows = views.reads(spark, sf_dir, ["cigar", "mate_position", "insert_size"]).filter((F.col("insert_size") > 0) & (F.col("mate_position") > 0))
    ends = F.array(
        F.struct(F.col("start_pos").alias("s"), (F.col("start_pos") + fr.reference_length(F.col("cigar")) - 1).alias("e")),
        F.struct(F.col("mate_position").cast("long").alias("s"), (F.col("start_pos") + F.col("insert_size") - 1).alias("e")),
    )
    both = rows.select("read_id", "chrom", "strand", F.inline(ends))
    seen = rangejoin.bin_join(points, both, ["chrom", "strand"], "pos", "s", "e").select("read_id", "chrom", "strand", "pos").distinct()
    w = Window.partitionBy("read_id").orderBy("pos")
    steps = seen.select("chrom", "strand", F.col("pos").alias("c1"), F.lead("pos").over(w).alias("_n"))
    return pairs.join(steps, ["chrom", "strand", "c1"]).filter("_n = c2").groupBy("chrom", "strand", "c1", "c2").agg(F.count("*").alias("n_reads"))


def region_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per covered region, its tested pairs and those with a p of at most 0.01."""
    tested = cut_lineage(methylation.pair_tests(spark, sf_dir).select("chrom", "c1", "p"))
    met = rangejoin.bin_join(tested, alignments._regions(spark, sf_dir).drop("strand"), ["chrom"], "c1", "start_pos", "end_pos")
    return met.groupBy("region_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("p") <= MOST_P).alias("n_significant"))


def deep_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with five calls or more, and their level."""
    rows = views.sites(spark, sf_dir).filter(F.col("cov") >= LEAST_DEPTH)
    return rows.select("chrom", "pos", "strand", "context", "mc", "cov", F.round(F.col("mc") / F.col("cov"), 6).alias("level"))


def read_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per read: bases of quality 13 or more, the sum of the lesser of base and mapping quality, and expected errors."""
    rows = read_table(spark, sf_dir, "alignedread").filter(F.col("read_id").isNotNull() & F.col("qual").isNotNull() & F.col("mapq").isNotNull() & (F.length("qual") == F.length("seq")))
    q = F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33)
    rows = rows.select("read_id", "mapq", q.alias("q"))
    return rows.select(
        "read_id",
        F.size(F.filter("q", lambda x: x >= LEAST_BASE_QUALITY)).alias("n_good"),
        F.aggregate("q", F.lit(0), lambda a, x: a + F.least(x, F.col("mapq"))).alias("capped"),
        F.round(F.aggregate("q", F.lit(0.0), lambda a, x: a + fr.unphred(x)), 4).alias("errors"),
    ).distinct()


def _alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads at single-base variants: read_id, strand, varid, vpos, base, quality and allele (0, 1 or null)."""
    v = haplotypes._variants(spark, sf_dir).filter((F.length("ref_allele") == 1) & (F.length(F.substring_index("alt_allele", ",", 1)) == 1))
    points = v.select("chrom", F.col("position").cast("long").alias("vpos"), "varid", F.upper("ref_allele").alias("ref"), F.upper(F.substring_index("alt_allele", ",", 1)).alias("alt"))
    rows = views.reads(spark, sf_dir, ["cigar", "seq", "qual", "mapq"]).select("read_id", "chrom", "strand", "mapq", "start_pos", "seq", "qual", F.explode(fr.aligned_blocks(F.col("cigar"))).alias("b"))
    part = lambda c: F.expr(f"substring({c}, b.read_at + 1, b.len)")
    start = F.col("start_pos") + F.col("b.ref_at")
    blocks = rows.select("read_id", "chrom", "strand", "mapq", start.alias("s"), (start + F.col("b.len") - 1).alias("e"), part("seq").alias("bases"), part("qual").alias("quals"))
    at = "cast(vpos - s as int) + 1, 1)"
    met = rangejoin.bin_join(points, blocks, ["chrom"], "vpos", "s", "e", 500)
    base = F.upper(F.expr(f"substring(bases, {at}"))
    quality = F.least(F.ascii(F.expr(f"substring(quals, {at}")) - 33, F.col("mapq"))
    return met.select("read_id", "strand", "varid", "vpos", "mapq", base.alias("base"), quality.alias("qv"), F.when(base == F.col("ref"), 0).when(base == F.col("alt"), 1).alias("allele"))


def read_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments from reads of mapping quality 20 or more: alleles of quality 13 or more, and how many the read has."""
    rows = _alleles(spark, sf_dir).filter((F.col("mapq") >= alignments.MAPQ) & F.col("allele").isNotNull() & (F.col("qv") >= LEAST_BASE_QUALITY))
    calls = rows.groupBy("read_id", "varid").agg(F.min("allele").alias("allele"), F.max("qv").alias("qv"))
    return calls.withColumn("n_calls", F.count("*").over(Window.partitionBy("read_id")))


def variant_site_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table of allele and state for each variant and called site up to 100 bases from it, and its exact test."""
    bases = _alleles(spark, sf_dir).filter(F.col("allele").isNotNull()).select("read_id", "varid", "vpos", "allele")
    calls = views.base_calls(spark, sf_dir).select("read_id", "pos", "methylated")
    near = bases.join(calls, "read_id").filter((F.col("pos") != F.col("vpos")) & (F.abs(F.col("pos") - F.col("vpos")) <= 100))
    n = lambda m, a: F.count_if((F.col("methylated") == m) & (F.col("allele") == a))
    t = near.groupBy("varid", "pos").agg(n(True, 0).alias("mr"), n(True, 1).alias("mv"), n(False, 0).alias("ur"), n(False, 1).alias("uv"))
    return t.withColumn("p", F.round(association.fisher_exact(*[F.col(c) for c in ("mr", "mv", "ur", "uv")]), 6))


def _suffix(ref: Column, alt: Column) -> Column:
    """Length of the common end of both alleles that leaves a base of each."""
    n = F.least(F.length(ref), F.length(alt)) - 1
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(ref, F.length(ref) - i + 1, i) == F.substring(alt, F.length(alt) - i + 1, i))
    return F.array_max(same)


def trimmed_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First alternative alleles without the end they share with the reference, their kind, and where they begin."""
    v = haplotypes._variants(spark, sf_dir).filter((F.length("ref_allele") > 0) & (F.length("alt_allele") > 0))
    v = v.select("varid", "position", F.upper("ref_allele").alias("r"), F.upper(F.substring_index("alt_allele", ",", 1)).alias("a"))
    v = v.withColumn("_n", _suffix(F.col("r"), F.col("a")))
    cut = lambda c: F.substring(F.col(c), F.lit(1), F.length(c) - F.col("_n"))
    out = v.select("varid", "position", cut("r").alias("ref"), cut("a").alias("alt"))
    kind = F.when(F.length("ref") == F.length("alt"), "snv").when(F.length("ref") < F.length("alt"), "insertion").otherwise("deletion")
    return out.select("varid", (F.col("position") + (kind != "snv").cast("int")).alias("position"), "ref", "alt", kind.alias("kind"))


def variant_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants in the order of their chromosomes' versions and of positions: how many come up to and with each."""
    v = haplotypes._variants(spark, sf_dir).select("varid", "chrom", F.col("position").cast("long").alias("position"))
    before = Window.orderBy("chrom_rank").rowsBetween(Window.unboundedPreceding, -1)
    chroms = haplotypes.natural_variant_order(spark, sf_dir).select(F.col("chrom").alias("_c"), F.coalesce(F.sum("n_variants").over(before), F.lit(0)).alias("_before"))
    own = rangejoin.running_total(v, ["chrom"], "position", F.lit(1), "_own", 1 << 20)
    return own.join(chroms, F.col("chrom") == F.col("_c")).select("varid", (F.col("_before") + F.col("_own")).alias("number"))


def edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of neighbouring calls and of all calls of fragments as one list without repeats."""
    calls = cut_lineage(views.calls(spark, sf_dir))
    return fg.path_edges(calls).select("a", "b").unionByName(fg.clique_edges(calls).select("a", "b")).distinct()


def top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five edges of each block that most fragments see."""
    calls = cut_lineage(views.calls(spark, sf_dir))
    edges = fg.path_edges(calls).select("a", "b", (F.col("same") + F.col("other")).alias("n"))
    placed = edges.join(fg.spanning_blocks(calls).select(F.col("varid").alias("a"), "block_id"), "a")
    w = Window.partitionBy("block_id").orderBy(F.desc("n"), "a", "b")
    return placed.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("block_id", "a", "b", "n", "place")


def distant_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of distant mates per library, within the greatest distance."""
    rows = read_table(spark, sf_dir, "hapfragments").filter((F.col("dtype") == 1) & (F.abs("isize") < MOST_DISTANCE))
    return rows.groupBy("library_id").agg(F.count("*").alias("n"), F.max(F.abs("isize")).alias("widest"))


def trans_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of each fragment of distant mates, mixed of both cases by the rate of its insert-size bin."""
    return linkage.trans_likelihood(variants_and_sites.distant_calls(spark, sf_dir), haplotypes._fixed(spark, sf_dir)).withColumn("ll", F.round("ll", 4) + 0.0)


QUERIES = {
    f.__name__: f
    for f in (
        het_sites_level, mate_strands, proper_pairs, marked_duplicates, admitted_reads, mate_site_pairs, region_pairs, deep_sites, read_qualities,
        read_fragments, variant_site_tests, trimmed_alleles, variant_ranks, edge_union, top_edges, distant_fragments, trans_loglik,
    )
}

_ALLELES = f"""{views.CALLS}, v AS (SELECT varid, chrom, position AS vpos, upper(ref_allele) AS ref, upper(split_part(alt_allele, ',', 1)) AS alt FROM readvariant
    WHERE varid IS NOT NULL AND chrom IS NOT NULL AND position IS NOT NULL AND length(ref_allele) = 1 AND length(split_part(alt_allele, ',', 1)) = 1),
  sq AS (SELECT read_id AS id, seq, qual, mapq FROM reads),
  al AS (SELECT read_id, strand, varid, vpos, mapq, upper(seq[read_at + (vpos - start_pos - ref_at) + 1]) AS base, least(ascii(qual[read_at + (vpos - start_pos - ref_at) + 1]) - 33, mapq) AS qv, ref, alt
    FROM v JOIN blk ON blk.chrom = v.chrom AND op = 'M' AND vpos BETWEEN start_pos + ref_at AND start_pos + ref_at + len - 1 JOIN sq ON sq.id = blk.read_id),
  ale AS (SELECT *, CASE WHEN base = ref THEN 0 WHEN base = alt THEN 1 END AS allele FROM al)"""
_HET = "mc >= 2 AND cov >= 6 AND mc / cov >= 0.1 AND mc / cov <= 0.9 AND mc > 2 AND cov - mc > 2"
_HETS = f"h AS (SELECT DISTINCT chrom, strand, pos::BIGINT AS pos FROM sites WHERE {_HET})"
_LNP = methylation._LNP.replace("lgamma", "LG").replace("mm", "mr").replace("mu", "mv").replace("um", "ur").replace("uu", "uv").replace("LG", "lgamma")

SQL = {
    "het_sites_level": f"""WITH s AS (SELECT row_id, pos, strand, floor(methlevel * coverage + 0.5)::BIGINT AS mc, coverage AS cov FROM methratio
      WHERE pos > 0 AND strand IN ('+', '-') AND coverage > 0 AND methlevel >= 0 AND methlevel <= 1 AND NOT isnan(methlevel)) SELECT * FROM s WHERE {_HET}""",
    "mate_strands": """SELECT CASE WHEN flag & 96 = 96 OR flag & 144 = 144 THEN '+' WHEN flag & 80 = 80 OR flag & 160 = 160 THEN '-' END AS strand, count(*) AS n_reads FROM alignedread GROUP BY 1""",
    "proper_pairs": f"""SELECT library_id, CASE WHEN abs(insert_size) <= {MOST_INSERT} THEN 'paired' ELSE 'single' END AS kind, count(*) AS n_reads FROM alignedread
      WHERE flag & 2 = 2 AND flag & {0x100 | 0x200 | 0x800} = 0 AND (mate_chrom = '=' OR mate_chrom = chrom) GROUP BY ALL""",
    "marked_duplicates": f"""WITH {views.READS} SELECT read_id, CASE WHEN row_number() OVER (PARTITION BY chrom, strand, start_pos, end_pos ORDER BY coalesce(mapq, -1) DESC, read_id) > 1
      THEN flag | 1024 ELSE flag END AS flag FROM reads WHERE strand IS NOT NULL""",
    "admitted_reads": f"""WITH {views.READS}, {views.SITES}, {_HETS} SELECT read_id, count(*) AS n_sites FROM reads r JOIN h ON h.chrom = r.chrom AND h.strand = r.strand
      AND h.pos BETWEEN start_pos AND end_pos GROUP BY read_id HAVING count(*) >= 2""",
    "mate_site_pairs": f"""WITH {views.READS}, {views.SITES}, {_HETS}, n AS (SELECT chrom, strand, pos AS c1, lead(pos) OVER (PARTITION BY chrom, strand ORDER BY pos) AS c2 FROM h),
      r AS (SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MD]', 1), lambda x: x::INT)), 0) AS l FROM reads WHERE insert_size > 0 AND mate_position > 0)
      SELECT n.chrom, n.strand, c1, c2, count(*) AS n_reads FROM n JOIN r ON r.chrom = n.chrom AND r.strand = n.strand
        AND (c1 BETWEEN start_pos AND start_pos + l - 1 OR c1 BETWEEN mate_position AND start_pos + insert_size - 1)
        AND (c2 BETWEEN start_pos AND start_pos + l - 1 OR c2 BETWEEN mate_position AND start_pos + insert_size - 1) GROUP BY ALL""",
    "region_pairs": f"""WITH {methylation._TESTS}, {alignments._BINNED.split('met AS')[0].rstrip().rstrip(',').replace(views.READS + ',', '')}
      SELECT region_id, count(*) AS n_pairs, count(*) FILTER (p <= {MOST_P}) AS n_significant FROM tests t JOIN regions g ON g.chrom = t.chrom AND c1 BETWEEN g.start_pos AND g.end_pos GROUP BY region_id""",
    "deep_sites": f"WITH {views.SITES} SELECT chrom, pos, strand, context, mc, cov, round(mc / cov, 6) AS level FROM sites WHERE cov >= {LEAST_DEPTH}",
    "read_qualities": f"""WITH q AS (SELECT DISTINCT read_id, mapq, list_transform(string_split(qual, ''), lambda c: ascii(c) - 33) AS q FROM alignedread
        WHERE read_id IS NOT NULL AND qual IS NOT NULL AND mapq IS NOT NULL AND length(qual) = length(seq))
      SELECT DISTINCT read_id, len(list_filter(q, lambda x: x >= {LEAST_BASE_QUALITY}))::INT AS n_good, list_sum(list_transform(q, lambda x: least(x, mapq)))::INT AS capped,
        round(list_sum(list_transform(q, lambda x: pow(10.0, -x / 10.0))), 4) AS errors FROM q""",
    "read_fragments": f"""WITH {_ALLELES}, c AS (SELECT read_id, varid, min(allele) AS allele, max(qv) AS qv FROM ale WHERE mapq >= {alignments.MAPQ} AND allele IS NOT NULL AND qv >= {LEAST_BASE_QUALITY} GROUP BY ALL)
      SELECT *, count(*) OVER (PARTITION BY read_id) AS n_calls FROM c""",
    "variant_site_tests": f"""WITH {_ALLELES}, t AS (SELECT varid, pos, count(*) FILTER (methylated AND allele = 0) AS mr, count(*) FILTER (methylated AND allele = 1) AS mv,
        count(*) FILTER (NOT methylated AND allele = 0) AS ur, count(*) FILTER (NOT methylated AND allele = 1) AS uv FROM ale JOIN calls c ON c.read_id = ale.read_id
        WHERE allele IS NOT NULL AND pos <> vpos AND abs(pos - vpos) <= 100 GROUP BY ALL),
      g AS (SELECT *, unnest(range(greatest(0, mr - uv), least(mr + mv, mr + ur) + 1)) AS i FROM t)
      SELECT varid, pos, mr, mv, ur, uv, round(least(1.0, sum(CASE WHEN {_LNP.format('i')} <= {_LNP.format('mr')} + {association.TIE} THEN exp({_LNP.format('i')}) ELSE 0 END)), 6) AS p FROM g GROUP BY ALL""",
    "trimmed_alleles": """WITH v AS (SELECT varid, position, upper(ref_allele) AS r, upper(split_part(alt_allele, ',', 1)) AS a FROM readvariant
        WHERE varid IS NOT NULL AND chrom IS NOT NULL AND position IS NOT NULL AND length(ref_allele) > 0 AND length(alt_allele) > 0),
      n AS (SELECT *, list_max(list_filter(range(least(length(r), length(a))), lambda i: right(r, i) = right(a, i))) AS n FROM v),
      t AS (SELECT varid, position, left(r, length(r) - n) AS ref, left(a, length(a) - n) AS alt FROM n),
      k AS (SELECT *, CASE WHEN length(ref) = length(alt) THEN 'snv' WHEN length(ref) < length(alt) THEN 'insertion' ELSE 'deletion' END AS kind FROM t)
      SELECT varid, position + CASE WHEN kind = 'snv' THEN 0 ELSE 1 END AS position, ref, alt, kind FROM k""",
    "variant_ranks": f"""WITH {haplotypes._V} SELECT varid, count(*) OVER (ORDER BY regexp_extract(chrom, '^([^0-9]*)', 1), try_cast(regexp_extract(chrom, '^[^0-9]*([0-9]*)', 1) AS BIGINT) NULLS FIRST,
      regexp_extract(chrom, '^[^0-9]*[0-9]*(.*)$', 1), position RANGE UNBOUNDED PRECEDING) AS number FROM v""",
    "edge_union": f"""WITH {views.FRAGMENT_CALLS} SELECT DISTINCT x.varid AS a, y.varid AS b FROM calls x JOIN calls y ON x.frag_id = y.frag_id AND x.varid < y.varid""",
    "top_edges": f"""WITH {views.FRAGMENT_CALLS}, {haplotypes._EDGES}, {haplotypes._BLOCKS} SELECT block_id, a, b, same + other AS n,
      row_number() OVER (PARTITION BY block_id ORDER BY same + other DESC, a, b) AS place FROM edges JOIN blocks ON varid = a QUALIFY place <= 5""",
    "distant_fragments": f"""SELECT library_id, count(*) AS n, max(abs(isize)) AS widest FROM hapfragments WHERE dtype = 1 AND abs(isize) < {MOST_DISTANCE} GROUP BY library_id""",
    "trans_loglik": variants_and_sites.SQL["trans_rates"]
    .replace("b AS (SELECT a.isize,", "b AS (SELECT a.frag_id, a.isize,").replace("l AS (SELECT isize,", "l AS (SELECT frag_id, isize,")
    .replace("SELECT bin, n, round((lo + hi) / 2, 6) AS rate FROM s WHERE i = 40", f"""SELECT frag_id, round({haplotypes._LOG_SUM.format('(log10(1 - (lo + hi) / 2) + cis)', '(log10((lo + hi) / 2) + trans)')}, 4) + 0.0 AS ll
        FROM l JOIN s ON s.bin = abs(isize) // 5000 AND i = 40"""),
}
