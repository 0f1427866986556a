"""Queries that write tables in the text formats and read them again, and the streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import reads as fr
from strandweave.operators import fragments as fg
from strandweave.operators import linkage
from strandweave.plans import alignments, haplotypes, methylation, states, variants_and_sites, views
from strandweave.session import cut_lineage, read_table, shared_path
from strandweave.sources import text
from strandweave.streaming import windows


def _through(lines: DataFrame) -> DataFrame:
    """Lines written to files in the shared folder and read from there."""
    path = shared_path(lines.sparkSession, "text")
    text.write_lines(lines, path)
    return text.read_lines(lines.sparkSession, path)


def methratio_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio rows through ratio files: rows and calls per chromosome."""
    rows = read_table(spark, sf_dir, "methratio").filter(F.col("chr").isNotNull()).withColumnRenamed("chr", "chrom")
    back = text.parse_methratio(_through(text.methratio_lines(rows)))
    return back.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("coverage").alias("coverage"), F.sum("c_count").alias("c_count"), F.count("eff_ct").alias("n_eff"))


def vcf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "readvariant").filter(F.col("chrom").isNotNull() & F.col("ref_allele").isNotNull() & F.col("gt").isNotNull())
    return text.parse_vcf(_through(text.vcf_lines(rows))).select("chrom", "position", "ref_allele", "alt_allele", "qual", "filter_tag", "gt")


def strand_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heterozygous sites as variants, in files of their own for each strand."""
    rows = methylation.split_sites_by_strand(spark, sf_dir).withColumnsRenamed({"pos": "position", "ref": "ref_allele", "alt": "alt_allele"})
    path = shared_path(spark, "text")
    text.write_lines(text.vcf_lines(rows, keep=("strand",)), path, ("strand",))
    parts = [text.parse_vcf(text.read_lines(spark, f"{path}/strand={s}")).withColumn("strand", F.lit(s)) for s in ("+", "-")]
    return parts[0].unionByName(parts[1]).select("chrom", "position", "strand", "ref_allele", "alt_allele", "qual", "gt")


def sam_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads through alignment files: per flag, reads, mismatches and lengths of states."""
    rows = read_table(spark, sf_dir, "alignedread").filter(F.col("read_id").isNotNull())
    back = text.parse_sam(_through(text.sam_lines(rows)))
    return back.groupBy("flag").agg(F.count("*").alias("n"), F.sum("nm").alias("nm"), F.sum(F.length("meth_state")).alias("state"), F.sum(F.length("seq")).alias("bases"))


def fragment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragment calls through fragment files."""
    runs = fg.fragment_runs(views.calls(spark, sf_dir))
    return text.parse_fragments(_through(text.fragment_lines(runs))).select("frag_id", "varid", "allele", "qv")


def fragment_text_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the new form, with the kind of fragment, the mate's first variant and the insert size."""
    heads = read_table(spark, sf_dir, "hapfragments").filter(F.col("frag_id").isNotNull() & (F.col("dtype") != 1))
    heads = heads.groupBy(F.col("frag_id").alias("_f")).agg(F.max("dtype").alias("dtype"), F.max("mate2_ix").alias("mate2_ix"), F.max("isize").alias("isize"))
    runs = fg.fragment_runs(views.calls(spark, sf_dir)).join(heads, F.col("frag_id") == F.col("_f"))
    return text.parse_fragments(_through(text.fragment_lines_new(runs)))


def _phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "readvariant").select("varid", "chrom", F.col("position").alias("pos"), F.col("ref_allele").alias("ref"), F.col("alt_allele").alias("alt"), "gt")
    return haplotypes.chain_phase(spark, sf_dir).join(v, "varid")


def block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phased blocks through block files."""
    back = text.parse_blocks(_through(text.block_lines(_phased(spark, sf_dir).withColumn("mismatch_q", F.lit(100.0)))))
    return back.select("varid", F.col("hap1").cast("int").alias("hap1"), F.col("hap2").cast("int").alias("hap2"), "chrom", "pos")


def merged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles of phased blocks through merged haplotype files."""
    rows = _phased(spark, sf_dir).filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull() & F.col("ref").isNotNull() & F.col("alt").isNotNull())
    zero, minus = F.col("hap") == 0, F.col("ref").isin("G", "A")
    one, two = F.when(zero, F.col("ref")).otherwise(F.col("alt")), F.when(zero, F.col("alt")).otherwise(F.col("ref"))
    rows = rows.select("block_id", "chrom", "pos", one.alias("hap1"), two.alias("hap2"), F.when(minus, 2).otherwise(1).alias("source"))
    return text.parse_merged(_through(text.merged_lines(rows)))


def phased_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants through files with their phase and block."""
    phases = haplotypes.chain_phase(spark, sf_dir).withColumnRenamed("varid", "_v")
    v = read_table(spark, sf_dir, "readvariant").filter(F.col("chrom").isNotNull() & F.col("position").isNotNull())
    back = text.parse_vcf(_through(text.phased_vcf_lines(v.join(phases, F.col("varid") == F.col("_v"), "left"))))
    phase = F.split("sample", ":")
    return back.select("chrom", "position", "ref_allele", "alt_allele", F.get(phase, F.lit(1)).alias("phase"), F.get(phase, F.lit(2)).try_cast("long").alias("block_id"))


def pair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested pairs through pair files with their breaks."""
    rows = methylation.pair_tests(spark, sf_dir)
    return text.parse_pairs(_through(text.pair_lines(cut_lineage(rows)))).withColumn("p", F.round("p", 6))


def bed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele-specific regions through bed files."""
    return text.parse_bed(_through(text.region_lines(methylation.asm_regions(spark, sf_dir))))


def region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered regions through four kinds of annotation files."""
    rows = cut_lineage(alignments._regions(spark, sf_dir))
    out = None
    for kind in ("gtf", "gff", "bed4", "ped3"):
        one = text.parse_regions(_through(text.region_lines(rows, kind)), kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def wig_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of CpG sites of the plus strand through track files."""
    rows = views.sites(spark, sf_dir).filter((F.col("context") == "CG") & (F.col("strand") == "+")).select("chrom", "pos", (F.col("mc") / F.col("cov")).alias("level"))
    return text.parse_wig(_through(text.wig_lines(rows)))


def rate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of distant mates through their file, put to the fragments of each bin."""
    rates = text.parse_rates(_through(text.rate_lines(variants_and_sites.trans_rates(spark, sf_dir), linkage.TRANS_BIN)), linkage.TRANS_BIN)
    frags = read_table(spark, sf_dir, "hapfragments").filter((F.col("dtype") == 1) & F.col("isize").isNotNull())
    counts = frags.groupBy(F.floor(F.abs("isize") / linkage.TRANS_BIN).alias("_bin")).agg(F.count("*").alias("n_fragments"))
    return counts.join(rates, F.col("_bin") == F.col("bin")).select("bin", "rate", "n_fragments")


def fasta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of reads through sequence files: length and G and C of each read."""
    rows = views.reads(spark, sf_dir, ["seq"]).filter(F.length("seq") > 0).select(F.col("read_id").alias("chrom"), "seq")
    path = shared_path(spark, "text")
    text.write_lines(text.fasta_lines(rows), path)
    chunks = text.read_fasta(spark, path)
    return chunks.groupBy(F.col("chrom").alias("read_id")).agg(F.sum(F.length("seq")).alias("n_bases"), F.sum(F.length(F.regexp_replace("seq", "[^GC]", ""))).alias("n_gc"))


def state_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called states through tagged alignment files."""
    rows = states._called(spark, sf_dir).withColumn("hit", fr.hit_type(F.col("flag")))
    raw = read_table(spark, sf_dir, "alignedread").columns
    wrong = F.length(F.regexp_replace("state", "[^ACGT]", ""))
    empty = {c: F.lit(None).cast("string") for c in ("qual", "mate_chrom", "mate_position", "insert_size", "mapq") if c in raw}
    lines = rows.withColumns(
        {
            "position": F.col("start_pos"), "nm": wrong, "meth_state": F.col("state"), "yc": F.when(F.col("hit").isin(1, 4), "CT").otherwise("GA"),
            "yd": F.when(F.col("hit").isin(1, 2), "f").otherwise("r"), **empty,
        }
    )
    return text.parse_sam(_through(text.sam_lines(lines))).select("read_id", "nm", "meth_state", "yc", "yd")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream: events and values per hour and type, of the hours that its watermark closes."""
    stream = windows.table_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    out = windows.run_to_table(windows.windowed_counts(stream, "at", "event_type", "value", "1 hour"))
    return out.select(F.unix_seconds("start_at").alias("start_at"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream: sessions per user with gaps below an hour, of those that its watermark closes."""
    stream = windows.table_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), "user_id")
    out = windows.run_to_table(windows.session_counts(stream, "at", ["user_id"], "1 hour"))
    return out.select("user_id", F.unix_micros("start_at").alias("start_us"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        methratio_text, vcf_text, strand_vcf, sam_text, state_sam, fragment_text, fragment_text_new, block_text, merged_text, phased_vcf, pair_text,
        bed_text, region_text, wig_text, rate_text, fasta_text, stream_windows, stream_sessions,
    )
}

_CHAINED = f"{views.FRAGMENT_CALLS}, {haplotypes._EDGES}, {haplotypes._BLOCKS}, {haplotypes._CHAIN}"

SQL = {
    "methratio_text": """SELECT chr AS chrom, count(*) AS n, sum(coverage)::BIGINT AS coverage, sum(c_count)::BIGINT AS c_count, count(eff_ct) AS n_eff
      FROM methratio WHERE chr IS NOT NULL GROUP BY chr""",
    "vcf_text": """SELECT chrom, position, ref_allele, coalesce(alt_allele, '.') AS alt_allele, qual, coalesce(filter_tag, '.') AS filter_tag, gt FROM readvariant
      WHERE chrom IS NOT NULL AND ref_allele IS NOT NULL AND gt IS NOT NULL""",
    "sam_text": """SELECT flag, count(*) AS n, sum(nm)::BIGINT AS nm, sum(length(meth_state))::BIGINT AS state, sum(length(coalesce(seq, '*')))::BIGINT AS bases
      FROM alignedread WHERE read_id IS NOT NULL GROUP BY flag""",
    "fragment_text": f"WITH {views.FRAGMENT_CALLS} SELECT frag_id, varid, allele, qv FROM calls",
    "block_text": f"""WITH {views.FRAGMENT_CALLS}, {haplotypes._EDGES}, {haplotypes._BLOCKS}, {haplotypes._CHAIN}
      SELECT chain.varid, hap AS hap1, 1 - hap AS hap2, chrom, position AS pos FROM chain JOIN readvariant r ON r.varid = chain.varid""",
    "strand_vcf": f"""SELECT chrom, pos AS position, strand, ref AS ref_allele, alt AS alt_allele, qual, gt FROM ({methylation.SQL['split_sites_by_strand']})""",
    "state_sam": f"""WITH {states._CALLED}, d AS (SELECT *, {states._HIT} AS hit FROM st) SELECT read_id, length(regexp_replace(state, '[^ACGT]', '', 'g'))::INT AS nm,
      state AS meth_state, CASE WHEN hit IN (1, 4) THEN 'CT' ELSE 'GA' END AS yc, CASE WHEN hit IN (1, 2) THEN 'f' ELSE 'r' END AS yd FROM d""",
    "fragment_text_new": f"""WITH {views.FRAGMENT_CALLS}, hd AS (SELECT frag_id, max(dtype) AS dtype, max(mate2_ix) AS mate2_ix, max(isize) AS isize FROM hapfragments
        WHERE frag_id IS NOT NULL AND dtype <> 1 GROUP BY frag_id)
      SELECT calls.frag_id, varid, allele, qv, dtype, coalesce(mate2_ix, -1) AS mate2_ix, coalesce(isize, -1) AS isize FROM calls JOIN hd ON hd.frag_id = calls.frag_id""",
    "merged_text": f"""WITH {_CHAINED} SELECT chrom, position AS pos, CASE WHEN hap = 0 THEN ref_allele ELSE alt_allele END AS hap1, CASE WHEN hap = 0 THEN alt_allele ELSE ref_allele END AS hap2,
      CASE WHEN ref_allele IN ('G', 'A') THEN 2 ELSE 1 END AS source FROM chain JOIN readvariant r ON r.varid = chain.varid
      WHERE chrom IS NOT NULL AND position IS NOT NULL AND ref_allele IS NOT NULL AND alt_allele IS NOT NULL""",
    "phased_vcf": f"""WITH {_CHAINED} SELECT chrom, position, coalesce(ref_allele, '.') AS ref_allele, coalesce(alt_allele, '.') AS alt_allele,
      CASE WHEN block_id IS NULL THEN '.' ELSE hap || '|' || (1 - hap) END AS phase, block_id FROM readvariant r LEFT JOIN chain ON chain.varid = r.varid
      WHERE chrom IS NOT NULL AND position IS NOT NULL""",
    "pair_text": methylation.SQL["pair_tests"].replace("uu, p, round(q, 6) AS q FROM", "uu, p FROM"),
    "bed_text": methylation.SQL["asm_regions"].replace("SELECT chrom, strand, min(c1)", "SELECT chrom, min(c1)"),
    "region_text": f"""WITH {alignments._BINNED.split('met AS')[0].rstrip().rstrip(',')}, r AS (SELECT region_id, chrom, start_pos, end_pos, CASE WHEN neg THEN '-' ELSE '+' END AS strand FROM regions)
      SELECT region_id, chrom, start_pos, end_pos, strand, unnest(['gtf', 'gff', 'bed4']) AS kind FROM r UNION ALL SELECT region_id, chrom, start_pos, start_pos, strand, 'ped3' FROM r""",
    "wig_text": f"WITH {views.SITES} SELECT chrom, pos, round(mc / cov, 6) AS level FROM sites WHERE context = 'CG' AND strand = '+'",
    "rate_text": variants_and_sites.SQL["trans_rates"].replace("SELECT bin, n, round((lo + hi) / 2, 6) AS rate FROM s WHERE i = 40", """SELECT s.bin, round((lo + hi) / 2, 6) AS rate, f.n AS n_fragments
        FROM s JOIN (SELECT (abs(isize) // 5000)::BIGINT AS bin, count(*) AS n FROM hapfragments WHERE dtype = 1 AND isize IS NOT NULL GROUP BY 1) f ON f.bin = s.bin WHERE i = 40"""),
    "fasta_text": f"""WITH {views.READS} SELECT read_id, length(seq) AS n_bases, length(regexp_replace(upper(seq), '[^GC]', '', 'g')) AS n_gc FROM reads WHERE length(seq) > 0""",
    "stream_windows": """SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
      WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' FROM events) GROUP BY ALL""",
    "stream_sessions": """WITH f AS (SELECT user_id, epoch_us(ts) AS a, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS x FROM events),
      g AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY a) AS i FROM f) SELECT user_id, min(a) AS start_us, count(*) AS n FROM g GROUP BY user_id, i
      HAVING max(a) + 3600000000 <= (SELECT epoch_us(date_trunc('milliseconds', max(ts))) - 600000000 FROM events)""",
}
