"""Queries of the general problems (1, 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import intervals, rejects, skew
from strandweave.session import read_table

HEAVY_SHARE = 0.05


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = read_table(spark, sf_dir, "alignedread")
    return reads.filter(F.col("chrom").isNotNull() & (F.col("chrom") != "*"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.periods_and_gaps(_placed(spark, sf_dir), ["library_id", "chrom"], "position", "span")


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered bases per library and chrom, with the share of the contig where its size is known."""
    covered = intervals.covered_bases(_placed(spark, sf_dir), ["library_id", "chrom"], "position", "span")
    sizes = read_table(spark, sf_dir, "contig_sizes").groupBy("contig").agg(F.max("size_bp").alias("size_bp"))
    return covered.join(sizes, F.col("chrom") == F.col("contig"), "left").select(
        "library_id",
        "chrom",
        "n_periods",
        "covered_bp",
        F.round(F.col("covered_bp") / F.col("size_bp"), 9).alias("covered_share"),
    )


def _frequencies(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "alignedread": skew.value_frequencies(read_table(spark, sf_dir, "alignedread"), "chrom", F.col("span").cast("long")),
        "methratio": skew.value_frequencies(read_table(spark, sf_dir, "methratio"), "chr", F.col("coverage").cast("long")),
    }


def _each(parts: dict[str, DataFrame], make) -> DataFrame:
    one, two = (make(freq).select(F.lit(name).alias("table_name"), "*") for name, freq in parts.items())
    return one.unionByName(two)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _each(_frequencies(spark, sf_dir), lambda freq: skew.heavy_keys(freq, HEAVY_SHARE))
    return found.select("table_name", F.col("key").alias("chrom"))


def p4_key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete results per key: rows, exact number of values, sum and mode of span and of coverage."""
    return _each(_frequencies(spark, sf_dir), skew.summarize_keys).withColumnRenamed("key", "chrom")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of span and of coverage per key."""
    found = _each(_frequencies(spark, sf_dir), lambda freq: skew.weighted_percentiles(freq, [0.25, 0.5, 0.9]))
    return found.withColumnRenamed("key", "chrom")


def p4_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered bases per chrom over all libraries: from reads, and as different called positions."""
    reads = intervals.covered_bases(_placed(spark, sf_dir), ["chrom"], "position", "span")
    calls = skew.summarize_keys(
        skew.value_frequencies(read_table(spark, sf_dir, "methratio"), "chr", F.col("pos").cast("long"))
    )
    return reads.select(F.lit("alignedread").alias("table_name"), "chrom", "covered_bp").unionByName(
        calls.select(F.lit("methratio").alias("table_name"), F.col("key").alias("chrom"), F.col("n_values").alias("covered_bp"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected_lines(read_table(spark, sf_dir, "methratio_raw"))


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.valid_rows(read_table(spark, sf_dir, "methratio_raw"))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_coverage, p4_found, p4_key_report, p4_percentiles, p4_covered, p5_found, p5_rows)
}


def _islands(keys: str) -> str:
    return f"""r AS (SELECT {keys}, position::BIGINT AS s, position::BIGINT + span - 1 AS e FROM alignedread
      WHERE chrom IS NOT NULL AND chrom <> '*' AND position > 0 AND span > 0),
    m AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
    g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END)
      OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m),
    p AS (SELECT {keys}, min(s) AS start_pos, max(e) AS end_pos FROM g GROUP BY {keys}, i)"""


_FREQ = """f AS (SELECT 'alignedread' AS table_name, chrom, span::BIGINT AS v FROM alignedread
    UNION ALL SELECT 'methratio', chr, coverage::BIGINT FROM methratio)"""

# A line's fields: each ends with a tab, one is added at the end.
_LINES = """l AS (SELECT raw_id, regexp_replace(line, '\\r$', '') AS t FROM methratio_raw),
  d AS (SELECT raw_id, t, regexp_extract_all(t || chr(9), '("(?:[^"]|"")*"|[^"\\t]*)\\t', 1) AS raw FROM l
    WHERE regexp_matches(t, '\\S') AND NOT starts_with(t, '#')),
  c AS (SELECT raw_id, t, len(raw) AS n, list_transform(raw, lambda x: trim(CASE WHEN starts_with(x, '"')
    THEN replace(x[2:-2], '""', '"') ELSE x END)) AS v FROM d),
  j AS (SELECT *, CASE WHEN NOT regexp_full_match(t, '(?:[^"\\t]*|"(?:[^"]|"")*")(?:\\t(?:[^"\\t]*|"(?:[^"]|"")*"))*') THEN 'quoting'
    WHEN n <> 12 THEN 'column_count'
    WHEN NOT coalesce(regexp_full_match(v[2], '[0-9]+') AND try_cast(v[2] AS HUGEINT) BETWEEN 1 AND 2147483647
      AND regexp_full_match(v[6], '[0-9]+') AND try_cast(v[6] AS HUGEINT) BETWEEN 0 AND 2147483647
      AND regexp_full_match(v[7], '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
      AND try_cast(v[7] AS DOUBLE) BETWEEN 0 AND 1, false) THEN 'invalid_value' END AS reason FROM c)"""

SQL = {
    "p1_found": f"""WITH {_islands('library_id, chrom')},
    x AS (SELECT *, lead(start_pos) OVER (PARTITION BY library_id, chrom ORDER BY start_pos) AS n FROM p)
    SELECT library_id, chrom, 'period' AS kind, start_pos, end_pos FROM x
    UNION ALL SELECT library_id, chrom, 'gap', end_pos + 1, n - 1 FROM x WHERE n IS NOT NULL""",
    "p1_coverage": f"""WITH {_islands('library_id, chrom')}
    SELECT library_id, chrom, count(*) AS n_periods, sum(end_pos - start_pos + 1)::BIGINT AS covered_bp,
      round(sum(end_pos - start_pos + 1)::DOUBLE / max(size_bp), 9) AS covered_share
    FROM p LEFT JOIN contig_sizes ON chrom = contig GROUP BY library_id, chrom""",
    "p4_found": f"""WITH {_FREQ}, t AS (SELECT table_name, count(*) AS n FROM f GROUP BY table_name)
    SELECT f.table_name, chrom FROM f JOIN t ON f.table_name = t.table_name WHERE chrom IS NOT NULL
    GROUP BY f.table_name, chrom, n HAVING count(*) >= {HEAVY_SHARE} * n""",
    "p4_key_report": f"""WITH {_FREQ}, c AS (SELECT table_name, chrom, v, count(*) AS w FROM f WHERE chrom IS NOT NULL GROUP BY ALL)
    SELECT table_name, chrom, sum(w)::BIGINT AS n_rows, count(v) AS n_values, sum(v * w)::BIGINT AS total,
      arg_max(v, w * 100000000000::HUGEINT - v) FILTER (WHERE v IS NOT NULL) AS mode FROM c GROUP BY table_name, chrom""",
    "p4_percentiles": f"""WITH {_FREQ}, r AS (SELECT *, row_number() OVER (PARTITION BY table_name, chrom ORDER BY v) AS i,
      count(*) OVER (PARTITION BY table_name, chrom) AS n FROM f WHERE chrom IS NOT NULL AND v IS NOT NULL),
    q AS (SELECT unnest([0.25, 0.5, 0.9])::DOUBLE AS point)
    SELECT table_name, chrom, point, v AS value FROM r, q WHERE i = greatest(1, ceil(point * n))""",
    "p4_covered": f"""WITH {_islands('chrom')}
    SELECT 'alignedread' AS table_name, chrom, sum(end_pos - start_pos + 1)::BIGINT AS covered_bp FROM p GROUP BY chrom
    UNION ALL SELECT 'methratio', chr, count(DISTINCT pos) FROM methratio WHERE chr IS NOT NULL GROUP BY chr""",
    "p5_found": f"WITH {_LINES} SELECT raw_id, reason FROM j WHERE reason IS NOT NULL",
    "p5_rows": f"""WITH {_LINES} SELECT raw_id, v[1] AS chr, v[2]::INT AS pos, v[3] AS strand, v[4] AS context,
    try_cast(v[5] AS INT) AS c_count, v[6]::INT AS coverage, v[7]::DOUBLE AS methlevel, try_cast(v[8] AS DOUBLE) AS eff_ct,
    try_cast(v[9] AS INT) AS rev_g, try_cast(v[10] AS INT) AS rev_ga, v[11] AS category, v[12] AS ctx5 FROM j WHERE reason IS NULL""",
}
