"""Queries that call states from bases. The reference is made from the reads, since no table holds one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import reads as fr
from strandweave.operators import methcall
from strandweave.plans import views
from strandweave.session import cut_lineage


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["cigar", "seq", "meth_state"]
    return views.reads(spark, sf_dir, columns).filter(F.col("strand").isNotNull()).select("read_id", "chrom", "strand", "flag", "start_pos", "end_pos", *columns)


def _reference(reads: DataFrame) -> DataFrame:
    """Each read votes for its bases, and for the cytosine of its strand where its state says so."""
    block = reads.select("chrom", "strand", "start_pos", "seq", "meth_state", F.explode(fr.aligned_blocks(F.col("cigar"))).alias("b"))
    part = lambda c: F.split(F.upper(F.expr(f"substring({c}, b.read_at + 1, b.len)")), "")
    each = block.select("chrom", "strand", (F.col("start_pos") + F.col("b.ref_at")).alias("at"), F.posexplode(F.arrays_zip(part("seq").alias("b"), part("meth_state").alias("s"))).alias("i", "x"))
    base = F.when(F.col("x.s").isin("Z", "X", "H"), F.when(F.col("strand") == "+", "C").otherwise("G")).otherwise(F.col("x.b"))
    return methcall.consensus(each.select("chrom", (F.col("at") + F.col("i")).alias("pos"), base.alias("base")))


def _called(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = cut_lineage(_reads(spark, sf_dir))
    return methcall.call_states(reads.drop("meth_state"), cut_lineage(_reference(reads)))


def called_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and bases before conversion of each read, with the tags of its kind of hit."""
    hit = fr.hit_type(F.col("flag"))
    tags = F.when(hit == 1, "CT f").when(hit == 4, "CT r").when(hit == 3, "GA r").when(hit == 2, "GA f")
    return _called(spark, sf_dir).select("read_id", "state", "original", tags.alias("tags"))


def called_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called sites with the counts of their own and of the other strand."""
    return methcall.state_counts(_called(spark, sf_dir))


def called_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by their mismatches, conversions not counted, and whether these are within the rate for their length."""
    wrong = F.length(F.regexp_replace("state", "[^ACGT]", ""))
    rows = _called(spark, sf_dir).select(wrong.alias("mismatches"), (wrong <= 0.5 + 0.06 * F.length("seq")).alias("kept"))
    return rows.groupBy("mismatches", "kept").agg(F.count("*").alias("n_reads"))


QUERIES = {f.__name__: f for f in (called_states, called_counts, called_mismatches)}

_CALLED = f"""{views.READS},
  cg AS (SELECT read_id, chrom, strand, flag, start_pos, seq, meth_state, cigar, list_transform(regexp_extract_all(cigar, '([0-9]+)[MIDSN]', 1), lambda x: x::INT) AS n,
      regexp_extract_all(cigar, '[0-9]+([MIDSN])', 1) AS o FROM reads WHERE strand IS NOT NULL),
  op AS (SELECT *, unnest(n) AS len, unnest(o) AS op, generate_subscripts(n, 1) AS k FROM cg),
  bk AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER w, 0)::INT AS ra, coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN len ELSE 0 END) OVER w, 0)::INT AS ga
    FROM op WINDOW w AS (PARTITION BY read_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ch AS (SELECT *, unnest(range(len)) AS j FROM bk WHERE op = 'M' AND seq IS NOT NULL),
  bs AS (SELECT *, start_pos + ga + j AS pos, upper(seq[ra + j + 1]) AS b, upper(meth_state[ra + j + 1]) AS st FROM ch WHERE ra + j + 1 <= length(seq)),
  vt AS (SELECT chrom, pos, CASE WHEN st IN ('Z', 'X', 'H') THEN CASE strand WHEN '+' THEN 'C' ELSE 'G' END ELSE b END AS v, count(*) AS n FROM bs GROUP BY ALL),
  rf AS (SELECT chrom, pos, v FROM vt WHERE v IN ('A', 'C', 'G', 'T') QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY n DESC, v) = 1),
  cl AS (SELECT bs.*, coalesce(r0.v, 'N') AS g, CASE strand WHEN '+' THEN r1.v WHEN '-' THEN translate(m1.v, 'ACGT', 'TGCA') END AS f1,
      CASE strand WHEN '+' THEN r2.v WHEN '-' THEN translate(m2.v, 'ACGT', 'TGCA') END AS f2
    FROM bs LEFT JOIN rf r0 ON r0.chrom = bs.chrom AND r0.pos = bs.pos LEFT JOIN rf r1 ON r1.chrom = bs.chrom AND r1.pos = bs.pos + 1
    LEFT JOIN rf r2 ON r2.chrom = bs.chrom AND r2.pos = bs.pos + 2 LEFT JOIN rf m1 ON m1.chrom = bs.chrom AND m1.pos = bs.pos - 1
    LEFT JOIN rf m2 ON m2.chrom = bs.chrom AND m2.pos = bs.pos - 2 WHERE regexp_full_match(cigar, '([0-9]+[MIDS])+')),
  sc AS (SELECT *, CASE WHEN f1 = 'G' THEN 'Z' WHEN f2 = 'G' THEN 'X' ELSE 'H' END AS cx, CASE strand WHEN '+' THEN 'C' ELSE 'G' END AS cy, CASE strand WHEN '+' THEN 'T' ELSE 'A' END AS cv FROM cl),
  ss AS (SELECT *, CASE WHEN g = cy AND b = cy THEN cx WHEN g = cy AND b = cv THEN lower(cx) WHEN b = g THEN '=' ELSE b END AS s FROM sc),
  pc AS (SELECT read_id, k, string_agg(s, '' ORDER BY j) AS s FROM ss GROUP BY read_id, k),
  st AS (SELECT bk.read_id, any_value(bk.flag) AS flag, any_value(bk.seq) AS seq, any_value(bk.strand) AS strand,
      string_agg(CASE WHEN bk.op = 'M' THEN pc.s ELSE repeat(bk.op, bk.len) END, '' ORDER BY bk.k) AS state
    FROM bk LEFT JOIN pc ON pc.read_id = bk.read_id AND pc.k = bk.k WHERE bk.seq IS NOT NULL AND regexp_full_match(bk.cigar, '([0-9]+[MIDS])+') GROUP BY bk.read_id)"""
_HIT = "CASE WHEN flag & 1 = 0 OR flag & 64 = 64 THEN CASE WHEN flag & 16 = 16 THEN 4 ELSE 1 END WHEN flag & 128 = 128 THEN CASE WHEN flag & 16 = 16 THEN 3 ELSE 2 END END"

SQL = {
    "called_states": f"""WITH {_CALLED}, d AS (SELECT *, replace(state, 'D', '') AS q, {_HIT} AS hit FROM st)
      SELECT read_id, state, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN q[i] IN ('z', 'x', 'h') THEN CASE strand WHEN '+' THEN 'C' ELSE 'G' END
        ELSE upper(seq[i]) END), '') AS original, CASE hit WHEN 1 THEN 'CT f' WHEN 4 THEN 'CT r' WHEN 3 THEN 'GA r' WHEN 2 THEN 'GA f' END AS tags FROM d""",
    "called_counts": f"""WITH {_CALLED}, own AS (SELECT chrom, strand, pos, max(upper(s)) AS u, count(*) FILTER (s = upper(s)) AS mc, count(*) AS cov FROM ss
        WHERE upper(s) IN ('Z', 'X', 'H') GROUP BY ALL),
      oth AS (SELECT chrom, CASE strand WHEN '+' THEN '-' ELSE '+' END AS strand, pos, count(*) FILTER (b = translate(cy, 'CG', 'GC')) AS rev_g,
        count(*) FILTER (b IN (translate(cy, 'CG', 'GC'), translate(cv, 'TA', 'AT'))) AS rev_ga FROM ss GROUP BY ALL)
      SELECT own.chrom, own.strand, own.pos, CASE u WHEN 'Z' THEN 'CG' WHEN 'X' THEN 'CHG' ELSE 'CHH' END AS context, mc, cov, coalesce(rev_g, 0) AS rev_g, coalesce(rev_ga, 0) AS rev_ga
      FROM own LEFT JOIN oth ON oth.chrom = own.chrom AND oth.strand = own.strand AND oth.pos = own.pos""",
    "called_mismatches": f"""WITH {_CALLED}, m AS (SELECT length(regexp_replace(state, '[^ACGT]', '', 'g')) AS mismatches, length(seq) AS l FROM st)
      SELECT mismatches::INT AS mismatches, mismatches <= 0.5 + 0.06 * l AS kept, count(*) AS n_reads FROM m GROUP BY ALL""",
}
