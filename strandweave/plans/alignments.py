"""Queries over aligned reads: filters, strands, depth, pairing, molecules and annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import reads as fr
from strandweave.operators import annotate, intervals, merge, rangejoin
from strandweave.plans import haplotypes, views
from strandweave.session import cut_lineage, read_table

MAPQ = 20
MOST_INSERT = 1000
MOLECULE_GAP = 20_000
INSERT_BIN = 100


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "alignedread")


def read_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that pass the quality filter, by strand, hit type and routing."""
    flag = F.col("flag")
    kept = _raw(spark, sf_dir).filter(fr.passes_quality(flag, F.col("mapq"), MAPQ))
    way = fr.routing(flag, F.col("chrom"), F.col("mate_chrom"), F.col("insert_size"), MOST_INSERT)
    return kept.groupBy(fr.strand(flag).alias("strand"), fr.hit_type(flag).alias("hit_type"), way.alias("routing")).agg(F.count("*").alias("n_reads"))


def cigar_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by reference length, read length and whether bases were inserted or clipped."""
    c = F.col("cigar")
    return _raw(spark, sf_dir).filter(c.rlike("[0-9]")).groupBy(
        fr.reference_length(c).alias("ref_len"), fr.cigar_length(c, "MIS").alias("read_len"), c.rlike("[IS]").alias("has_is")
    ).agg(F.count("*").alias("n_reads"))


def flag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("flag")
    return _raw(spark, sf_dir).groupBy("library_id").agg(
        F.count("*").alias("total"),
        F.count_if(~fr.has(flag, 0x4)).alias("mapped"),
        F.count_if(fr.has(flag, 0x1)).alias("paired"),
        F.count_if(fr.has(flag, 0x3) & ~fr.has(flag, 0x4)).alias("proper"),
        F.count_if(fr.has(flag, 0x40)).alias("first"),
        F.count_if(fr.has(flag, 0x80)).alias("second"),
        F.count_if(fr.has(flag, 0x400)).alias("duplicate"),
        F.count_if(F.col("mapq") >= MAPQ).alias("confident"),
    )


def chrom_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped and unmapped reads of each contig, with its size; contigs without reads too."""
    counts = _raw(spark, sf_dir).groupBy("chrom").agg(
        F.count_if(~fr.has(F.col("flag"), 0x4)).alias("mapped"), F.count_if(fr.has(F.col("flag"), 0x4)).alias("unmapped")
    )
    sizes = read_table(spark, sf_dir, "contig_sizes")
    return sizes.join(counts, F.col("contig") == F.col("chrom"), "left").select(
        "contig", "size_bp", F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("unmapped", F.lit(0)).alias("unmapped")
    )


def dedup_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read per library-independent place (chrom, strand, start and end): the best mapped, then the least name."""
    rows = views.reads(spark, sf_dir, ["mapq"]).filter(F.col("strand").isNotNull())
    best = F.min(F.struct((-F.coalesce("mapq", F.lit(-1))).alias("q"), "read_id")).alias("b")
    return rows.groupBy("chrom", "strand", "start_pos", "end_pos").agg(best, F.count("*").alias("n_reads")).select(
        "chrom", "strand", "start_pos", "end_pos", F.col("b.read_id").alias("read_id"), "n_reads"
    )


def read_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bases of each chromosome have which depth."""
    runs = rangejoin.depth_runs(views.reads(spark, sf_dir).select("chrom", "start_pos", "end_pos"), ["chrom"], "start_pos", "end_pos")
    return runs.groupBy("chrom", "depth").agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("n_bases"))


def site_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of the same strand over each site of the ratio files; sites without reads are left out."""
    points = views.sites(spark, sf_dir).select("chrom", "strand", F.col("pos").cast("long").alias("pos"))
    rows = views.reads(spark, sf_dir).select("read_id", "chrom", "strand", "start_pos", "end_pos")
    met = rangejoin.bin_join(points, rows, ["chrom", "strand"], "pos", "start_pos", "end_pos")
    return met.groupBy("chrom", "strand", "pos").agg(F.count("*").alias("n_reads"))


def reads_semi_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by chromosome, of chromosomes that have sites. Reads are counted first, so no chromosome's rows meet in a join."""
    with_sites = views.sites(spark, sf_dir).select("chrom").distinct()
    return views.reads(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n_reads")).join(with_sites, "chrom", "left_semi")


def mate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of two distant mates put together by their name: calls of either mate, and the insert size."""
    rows = (
        read_table(spark, sf_dir, "hapfragments")
        .filter((F.col("dtype") == 1) & (F.col("mate2_ix") >= 0) & F.col("frag_id").isNotNull())
        .select("frag_id", "mate2_ix", "isize", F.explode("alist").alias("c"))
        .filter(F.col("c.varid").isNotNull())
        .select("frag_id", "isize", (F.col("c.varid") >= F.col("mate2_ix")).alias("second"), "c.varid")
        .distinct()
    )
    side = lambda s, n: rows.filter(F.col("second") == s).groupBy("frag_id").agg(F.count("*").alias(f"n_{n}"), F.max("isize").alias(f"is_{n}"))
    return side(False, "first").join(side(True, "second"), "frag_id").select("frag_id", "n_first", "n_second", F.greatest("is_first", "is_second").alias("isize"))


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules: reads of one chromosome with gaps of at most 20 kb. The barcode is the read's name up to its first colon."""
    rows = views.reads(spark, sf_dir, []).select("read_id", "chrom", "start_pos", "end_pos", F.substring_index("read_id", ":", 1).alias("barcode"))
    cut = rangejoin.sessions(cut_lineage(rows), ["barcode", "chrom"], "start_pos", MOLECULE_GAP)
    return cut.groupBy("barcode", "chrom", "session_id").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("n_reads"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions over the event table: per user, gaps of at most an hour."""
    rows = read_table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    cut = rangejoin.sessions(rows, ["user_id"], "at", 3_600_000_000)
    return cut.groupBy("user_id", "session_id").agg(F.count("*").alias("n_events"), (F.max("at") - F.min("at")).alias("length_us"))


def insert_bin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs per insert-size bin, with a window that reaches half of the pairs below and above."""
    rows = _raw(spark, sf_dir).filter(F.col("insert_size") > 0)
    bins = rows.groupBy(F.floor(F.col("insert_size") / INSERT_BIN).alias("bin")).agg(F.count("*").alias("n"), F.sum("insert_size").alias("total"))
    w = Window.orderBy("bin")
    return bins.select(
        "bin", "n", F.sum("n").over(w.rangeBetween(-2, 2)).alias("n_window"), F.round(F.sum("total").over(w.rangeBetween(-2, 2)) / F.sum("n").over(w.rangeBetween(-2, 2)), 6).alias("mean_insert")
    )


def interval_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of overlapping reads per chromosome, over all libraries."""
    heads = intervals.covered_heads(views.reads(spark, sf_dir), ["chrom"], "start_pos", "span")
    return heads.select("chrom", F.col("_start").alias("start_pos"), F.col("_end").alias("end_pos"))


def cpg_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of one CpG on both strands: plus position + 1 = minus position."""
    s = views.sites(spark, sf_dir).filter(F.col("context") == "CG")
    plus = s.filter("strand = '+'").select("chrom", F.col("pos").alias("plus_pos"), F.col("mc").alias("plus_mc"), F.col("cov").alias("plus_cov"))
    minus = s.filter("strand = '-'").select("chrom", (F.col("pos") - 1).alias("plus_pos"), F.col("mc").alias("minus_mc"), F.col("cov").alias("minus_cov"))
    return plus.join(minus, ["chrom", "plus_pos"])


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to annotate: covered islands of at least 200 bases, on alternating strands by their start."""
    rows = interval_islands(spark, sf_dir).filter("end_pos - start_pos >= 199")
    name = F.concat_ws(":", "chrom", F.col("start_pos").cast("string"))
    return rows.select(name.alias("region_id"), "chrom", "start_pos", "end_pos", F.when(F.col("start_pos") % 2 == 0, "+").otherwise("-").alias("strand"))


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "methratio").filter(F.col("chr").isNotNull() & (F.col("pos") > 0))
    points = v.select(F.col("chr").alias("chrom"), F.col("pos").cast("long").alias("pos"))
    return annotate.site_bins(_regions(spark, sf_dir), points)


def annotation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.profile(_binned(spark, sf_dir))


def region_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.region_totals(_binned(spark, sf_dir))


def region_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.heatmap(_binned(spark, sf_dir))


def merge_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phased variants as blocks of two strands, split by their kind of substitution, merged again by their votes."""
    hap = cut_lineage(haplotypes.chain_phase(spark, sf_dir))
    v = read_table(spark, sf_dir, "readvariant").select("varid", "chrom", F.col("position").alias("pos"), "ref_allele", F.substring_index("alt_allele", ",", 1).alias("alt"))
    rows = hap.join(v, "varid").filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    minus = F.col("ref_allele").isin("G", "A")
    zero = F.col("hap") == 0
    links = rows.select(
        (F.col("block_id") * 2 + minus.cast("int")).alias("block_id"),
        "chrom",
        "pos",
        F.when(zero, F.col("ref_allele")).otherwise(F.col("alt")).alias("hap1"),
        F.when(zero, F.col("alt")).otherwise(F.col("ref_allele")).alias("hap2"),
        F.when(minus, 2).otherwise(1).alias("source"),
    )
    return merge.merge_strands(cut_lineage(links))


QUERIES = {
    f.__name__: f
    for f in (
        read_classes, cigar_lengths, flag_stats, chrom_stats, dedup_reads, read_depth, site_coverage, reads_semi_sites, mate_pairs, molecules,
        event_sessions, insert_bin_stats, interval_islands, cpg_neighbours, annotation_profile, region_totals,
        region_heatmap, merge_strands,
    )
}

_STRAND = """CASE WHEN flag & 2 = 0 THEN CASE WHEN flag & 16 = 16 THEN '-' ELSE '+' END
  WHEN flag & 96 = 96 OR flag & 144 = 144 THEN '+' WHEN flag & 80 = 80 OR flag & 160 = 160 THEN '-' END"""
_ISLANDS = f"""{views.READS},
  im AS (SELECT chrom, start_pos AS s, end_pos AS e, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM reads),
  ig AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM im),
  islands AS (SELECT chrom, min(s) AS start_pos, max(e) AS end_pos FROM ig GROUP BY chrom, i)"""
_BINNED = f"""{_ISLANDS},
  regions AS (SELECT chrom || ':' || start_pos AS region_id, chrom, start_pos, end_pos, start_pos % 2 = 1 AS neg FROM islands WHERE end_pos - start_pos >= 199),
  met AS (SELECT region_id, neg, pos < start_pos AS bf, pos > end_pos AS af, CASE WHEN pos < start_pos THEN pos - start_pos + 2000 WHEN pos > end_pos THEN pos - end_pos - 1
      ELSE pos - start_pos END AS o, CASE WHEN pos BETWEEN start_pos AND end_pos THEN end_pos - start_pos + 1 ELSE 2000 END AS w
    FROM regions JOIN methratio ON chr = chrom AND pos > 0 AND pos BETWEEN start_pos - 2000 AND end_pos + 2000),
  binned AS (SELECT region_id, CASE WHEN bf THEN CASE WHEN neg THEN 'down' ELSE 'up' END WHEN af THEN CASE WHEN neg THEN 'up' ELSE 'down' END ELSE 'body' END AS part,
    CASE WHEN neg THEN 39 - (o * 40 // w) ELSE o * 40 // w END AS bin FROM met)"""

SQL = {
    "read_classes": f"""SELECT {_STRAND} AS strand, CASE WHEN flag & 1 = 0 OR flag & 64 = 64 THEN CASE WHEN flag & 16 = 16 THEN 4 ELSE 1 END
        WHEN flag & 128 = 128 THEN CASE WHEN flag & 16 = 16 THEN 3 ELSE 2 END END AS hit_type,
      CASE WHEN flag & 1 = 0 OR flag & 8 = 8 OR NOT coalesce(mate_chrom = '=' OR mate_chrom = chrom, false) OR coalesce(insert_size, 0) = 0
        OR abs(insert_size) > {MOST_INSERT} THEN 'single' ELSE 'paired' END AS routing, count(*) AS n_reads
      FROM alignedread WHERE mapq >= {MAPQ} AND flag & 516 = 0 GROUP BY ALL""",
    "cigar_lengths": """SELECT coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MD]', 1), lambda x: x::INT)), 0)::INT AS ref_len,
      coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS]', 1), lambda x: x::INT)), 0)::INT AS read_len,
      regexp_matches(cigar, '[IS]') AS has_is, count(*) AS n_reads FROM alignedread WHERE regexp_matches(cigar, '[0-9]') GROUP BY ALL""",
    "flag_stats": f"""SELECT library_id, count(*) AS total, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 1 = 1) AS paired,
      count(*) FILTER (flag & 3 = 3 AND flag & 4 = 0) AS proper, count(*) FILTER (flag & 64 = 64) AS first, count(*) FILTER (flag & 128 = 128) AS second,
      count(*) FILTER (flag & 1024 = 1024) AS duplicate, count(*) FILTER (mapq >= {MAPQ}) AS confident FROM alignedread GROUP BY library_id""",
    "chrom_stats": """SELECT contig, size_bp, count(flag) FILTER (flag & 4 = 0) AS mapped, count(flag) FILTER (flag & 4 = 4) AS unmapped
      FROM contig_sizes LEFT JOIN alignedread ON chrom = contig GROUP BY contig, size_bp""",
    "dedup_reads": f"""WITH {views.READS}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom, strand, start_pos, end_pos ORDER BY coalesce(mapq, -1) DESC, read_id) AS k,
        count(*) OVER (PARTITION BY chrom, strand, start_pos, end_pos) AS n_reads FROM reads WHERE strand IS NOT NULL)
      SELECT chrom, strand, start_pos, end_pos, read_id, n_reads FROM r WHERE k = 1""",
    "read_depth": f"""WITH {views.READS}, ev AS (SELECT chrom, start_pos AS p, 1 AS d FROM reads UNION ALL SELECT chrom, end_pos + 1, -1 FROM reads),
      su AS (SELECT chrom, p, sum(d) AS d FROM ev GROUP BY ALL), r AS (SELECT chrom, sum(d) OVER w AS depth, lead(p) OVER w - p AS n FROM su WINDOW w AS (PARTITION BY chrom ORDER BY p))
      SELECT chrom, depth::BIGINT AS depth, sum(n)::BIGINT AS n_bases FROM r WHERE depth > 0 GROUP BY ALL""",
    "site_coverage": f"""WITH {views.READS}, {views.SITES} SELECT s.chrom, s.strand, s.pos::BIGINT AS pos, count(*) AS n_reads FROM sites s
      JOIN reads r ON r.chrom = s.chrom AND r.strand = s.strand AND s.pos BETWEEN r.start_pos AND r.end_pos GROUP BY ALL""",
    "reads_semi_sites": f"WITH {views.READS}, {views.SITES} SELECT chrom, count(*) AS n_reads FROM reads WHERE chrom IN (SELECT chrom FROM sites) GROUP BY chrom",
    "mate_pairs": """WITH c AS (SELECT frag_id, mate2_ix, isize, unnest(alist).varid AS v FROM hapfragments WHERE dtype = 1 AND mate2_ix >= 0 AND frag_id IS NOT NULL),
      r AS (SELECT DISTINCT frag_id, isize, v >= mate2_ix AS second, v FROM c WHERE v IS NOT NULL),
      a AS (SELECT frag_id, count(*) AS n, max(isize) AS i FROM r WHERE NOT second GROUP BY 1), b AS (SELECT frag_id, count(*) AS n, max(isize) AS i FROM r WHERE second GROUP BY 1)
      SELECT a.frag_id, a.n AS n_first, b.n AS n_second, greatest(a.i, b.i) AS isize FROM a JOIN b ON a.frag_id = b.frag_id""",
    "molecules": f"""WITH {views.READS}, x AS (SELECT split_part(read_id, ':', 1) AS barcode, chrom, start_pos, end_pos FROM reads),
      f AS (SELECT *, CASE WHEN start_pos - lag(start_pos) OVER (PARTITION BY barcode, chrom ORDER BY start_pos) <= {MOLECULE_GAP} THEN 0 ELSE 1 END AS n FROM x),
      g AS (SELECT *, sum(n) OVER (PARTITION BY barcode, chrom ORDER BY start_pos)::BIGINT AS session_id FROM f)
      SELECT barcode, chrom, session_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_reads FROM g GROUP BY barcode, chrom, session_id""",
    "event_sessions": """WITH f AS (SELECT user_id, epoch_us(ts) AS a, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS n FROM events),
      g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a)::BIGINT AS session_id FROM f)
      SELECT user_id, session_id, count(*) AS n_events, max(a) - min(a) AS length_us FROM g GROUP BY user_id, session_id""",
    "insert_bin_stats": f"""WITH b AS (SELECT (insert_size // {INSERT_BIN})::BIGINT AS bin, count(*) AS n, sum(insert_size) AS t FROM alignedread WHERE insert_size > 0 GROUP BY ALL)
      SELECT bin, n, sum(n) OVER w::BIGINT AS n_window, round(sum(t) OVER w / sum(n) OVER w, 6) AS mean_insert FROM b WINDOW w AS (ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "interval_islands": f"WITH {_ISLANDS} SELECT chrom, start_pos, end_pos FROM islands",
    "cpg_neighbours": f"""WITH {views.SITES} SELECT a.chrom, a.pos AS plus_pos, a.mc AS plus_mc, a.cov AS plus_cov, b.mc AS minus_mc, b.cov AS minus_cov
      FROM sites a JOIN sites b ON a.chrom = b.chrom AND a.pos + 1 = b.pos AND a.strand = '+' AND b.strand = '-' AND a.context = 'CG' AND b.context = 'CG'""",
    "annotation_profile": f"""WITH {_BINNED}, c AS (SELECT part, bin, count(*) AS n FROM binned GROUP BY ALL),
      g AS (SELECT * FROM (SELECT unnest(['up', 'body', 'down']) AS part), range(40) AS r(bin)),
      t AS (SELECT g.part, g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.part = g.part AND c.bin = g.bin),
      w AS (SELECT part, bin, sum(n) OVER (PARTITION BY part ORDER BY bin ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS n_sites FROM t)
      SELECT part, bin, n_sites FROM w WHERE bin > 0""",
    "region_totals": f"""WITH {_BINNED} SELECT region_id, count(*) FILTER (part = 'up') AS up, count(*) FILTER (part = 'body') AS body,
      count(*) FILTER (part = 'down') AS down FROM binned GROUP BY region_id""",
    "region_heatmap": f"""WITH {_BINNED} SELECT region_id, {', '.join(f"count(*) FILTER (bin // 4 = {i}) AS b{i}" for i in range(10))}, min(bin)::BIGINT AS first_bin
      FROM binned WHERE part = 'body' GROUP BY region_id""",
}
