"""Frames that several queries start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import reads as fr
from strandweave.operators.fragments import merge_mates
from strandweave.operators.sites import latest
from strandweave.session import read_table

READ_COLUMNS = ["read_id", "loaded_at", "chrom", "position", "flag", "mapq", "cigar", "mate_chrom", "mate_position", "insert_size", "span", "meth_state", "seq", "qual"]


def reads(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Usable reads, the latest delivery of each, with ``strand``, ``start_pos`` and ``end_pos``."""
    need = ["read_id", "loaded_at", "chrom", "position", "flag", "span", *(columns or [])]
    keep = [c for c in READ_COLUMNS if c in need]
    raw = read_table(spark, sf_dir, "alignedread").filter(
        F.col("read_id").isNotNull() & F.col("chrom").isNotNull() & (F.col("chrom") != "*") & (F.col("position") > 0) & (F.col("span") > 0)
    )
    start = F.col("position").cast("long")
    return latest(raw, ["read_id"], ["loaded_at"], keep).select(
        *keep, fr.strand(F.col("flag")).alias("strand"), start.alias("start_pos"), (start + F.col("span") - 1).alias("end_pos")
    )


READS = """reads AS (SELECT *, CASE WHEN flag & 2 = 0 THEN CASE WHEN flag & 16 = 16 THEN '-' ELSE '+' END
    WHEN flag & 96 = 96 OR flag & 144 = 144 THEN '+' WHEN flag & 80 = 80 OR flag & 160 = 160 THEN '-' END AS strand,
    position::BIGINT AS start_pos, position::BIGINT + span - 1 AS end_pos
  FROM alignedread WHERE read_id IS NOT NULL AND chrom IS NOT NULL AND chrom <> '*' AND position > 0 AND span > 0
  QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY loaded_at DESC NULLS LAST, chrom DESC, position DESC, flag DESC) = 1)"""


def base_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per called base: read_id, chrom, strand, pos, context and ``methylated``. A state string has a letter for
    each base of the read; its aligned runs are placed by the CIGAR string."""
    rows = reads(spark, sf_dir, ["cigar", "meth_state"]).filter(F.col("strand").isNotNull())
    block = rows.select("read_id", "chrom", "strand", "start_pos", "meth_state", F.explode(fr.aligned_blocks(F.col("cigar"))).alias("b"))
    run = block.select("read_id", "chrom", "strand", (F.col("start_pos") + F.col("b.ref_at")).alias("at"), F.expr("substring(meth_state, b.read_at + 1, b.len)").alias("s"))
    states = run.select("read_id", "chrom", "strand", "at", F.posexplode(F.split("s", "")).alias("i", "c")).filter(F.col("c").isin("Z", "z", "X", "x", "H", "h"))
    context = F.when(F.lower("c") == "z", "CG").when(F.lower("c") == "x", "CHG").otherwise("CHH")
    return states.select("read_id", "chrom", "strand", (F.col("at") + F.col("i")).alias("pos"), context.alias("context"), (F.upper("c") == F.col("c")).alias("methylated"))


CALLS = (
    READS
    + """,
  cig AS (SELECT read_id, chrom, strand, start_pos, meth_state,
      list_transform(regexp_extract_all(cigar, '([0-9]+)[MIDSN]', 1), lambda x: x::INT) AS n,
      regexp_extract_all(cigar, '[0-9]+([MIDSN])', 1) AS o FROM reads WHERE strand IS NOT NULL),
  ops AS (SELECT *, unnest(n) AS len, unnest(o) AS op, generate_subscripts(n, 1) AS k FROM cig),
  blk AS (SELECT read_id, chrom, strand, start_pos, meth_state, len, op,
      coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER w, 0)::INT AS read_at,
      coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN len ELSE 0 END) OVER w, 0)::INT AS ref_at
    FROM ops WINDOW w AS (PARTITION BY read_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  run AS (SELECT read_id, chrom, strand, start_pos + ref_at AS a0, meth_state[read_at + 1 : read_at + len] AS s FROM blk WHERE op = 'M'),
  chars AS (SELECT read_id, chrom, strand, a0, unnest(range(length(s))) AS i, s FROM run),
  calls AS (SELECT read_id, chrom, strand, a0 + i AS pos, CASE lower(s[i + 1]) WHEN 'z' THEN 'CG' WHEN 'x' THEN 'CHG' ELSE 'CHH' END AS context,
      upper(s[i + 1]) = s[i + 1] AS methylated FROM chars WHERE s[i + 1] IN ('Z', 'z', 'X', 'x', 'H', 'h'))"""
)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable ratio rows, the latest delivery of each site: chrom, pos, strand, context, mc, cov, rev_g, rev_ga."""
    chrom = F.when(F.col("chr").rlike("^([0-9]+|[XYM])$"), F.concat(F.lit("chr"), F.col("chr"))).otherwise(F.col("chr"))
    raw = (
        read_table(spark, sf_dir, "methratio")
        .filter((F.col("pos") > 0) & F.col("strand").isin("+", "-") & (F.col("coverage") > 0) & F.col("c_count").between(0, F.col("coverage")))
        .select(chrom.alias("chrom"), "pos", "strand", F.upper(F.trim("context")).alias("context"), F.col("c_count").alias("mc"), F.col("coverage").alias("cov"), "rev_g", "rev_ga", "loaded_at", "row_id")
        .filter(F.col("chrom").isNotNull() & F.col("context").isin("CG", "CHG", "CHH"))
    )
    keys = ["chrom", "pos", "strand", "context"]
    return latest(raw, keys, ["loaded_at", "row_id"], [*keys, "loaded_at", "row_id", "mc", "cov", "rev_g", "rev_ga"]).drop("loaded_at", "row_id")


SITES = """sites AS (SELECT * EXCLUDE (loaded_at, row_id) FROM (SELECT CASE WHEN regexp_full_match(chr, '[0-9]+|[XYM]') THEN 'chr' || chr ELSE chr END AS chrom,
      pos, strand, upper(trim(context)) AS context, c_count AS mc, coverage AS cov, rev_g, rev_ga, loaded_at, row_id FROM methratio
    WHERE pos > 0 AND strand IN ('+', '-') AND coverage > 0 AND c_count BETWEEN 0 AND coverage)
  WHERE chrom IS NOT NULL AND context IN ('CG', 'CHG', 'CHH')
  QUALIFY row_number() OVER (PARTITION BY chrom, pos, strand, context ORDER BY loaded_at DESC NULLS LAST, row_id DESC) = 1)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of local fragments (not of distant mates) at known variants, one per fragment and variant: frag_id, varid,
    allele (0 or 1) and qv. Equal repeats keep the best quality; contradicting ones are dropped."""
    rows = (
        read_table(spark, sf_dir, "hapfragments")
        .filter(F.col("frag_id").isNotNull() & (F.col("dtype") != 1))
        .select("frag_id", F.explode("alist").alias("c"))
        .filter(F.col("c.allele").isin("0", "1") & F.col("c.varid").isNotNull() & F.col("c.qv").isNotNull())
        .select("frag_id", "c.varid", F.col("c.allele").cast("int").alias("allele"), "c.qv")
        .join(read_table(spark, sf_dir, "readvariant").select("varid"), "varid", "left_semi")
    )
    return merge_mates(rows)


FRAGMENT_CALLS = """calls AS (SELECT frag_id, c.varid AS varid, min(c.allele::INT) AS allele, max(c.qv) AS qv
  FROM (SELECT frag_id, unnest(alist) AS c FROM hapfragments WHERE frag_id IS NOT NULL AND dtype <> 1)
  WHERE c.varid IN (SELECT varid FROM readvariant) AND c.allele IN ('0', '1') AND c.varid IS NOT NULL AND c.qv IS NOT NULL GROUP BY frag_id, c.varid HAVING min(c.allele) = max(c.allele))"""
