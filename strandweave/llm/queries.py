"""Queries of the training-data problems (2, 3, 6, 7 and 8), and SQL where it can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import groups, leaks, quantiles, tokens, truncation
from strandweave.session import cut_lineage, read_table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = read_table(spark, sf_dir, "readvariant").filter(F.col("varid").isNotNull())
    calls = (
        read_table(spark, sf_dir, "hapfragments")
        .select(F.coalesce(F.concat(F.lit("id "), "frag_id"), F.to_json("alist")).alias("frag"), F.explode("alist").alias("call"))
        .filter(F.col("call.allele").isin("0", "1"))
        .select("frag", "call.varid")
        .join(variants.select("varid"), "varid", "left_semi")
    )
    by_fragment = groups.member_edges(calls, F.col("frag"), F.col("varid"))
    by_block = groups.member_edges(variants, F.when(F.col("blocks") != 0, F.col("blocks")), F.col("varid"))
    return by_fragment.unionAll(by_block)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.connected_groups(_links(spark, sf_dir)).withColumnRenamed("member", "varid")


def p2_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups have how many members."""
    sizes = p2_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_members"))
    return sizes.groupBy("n_members").agg(F.count("*").alias("n_groups"))


KEYS = ("field_name", "chr", "context")
CASE_ROWS = 50
MEDIANS_BROADCAST = 200_000


def _values(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """One row per counting value: row_id, field_name, chr, context, value and its leaf, and ``more``."""
    context = F.upper(F.trim("context"))
    cov, level = F.col("coverage"), F.col("methlevel")
    parts = F.array(
        F.when(cov >= 0, F.struct(F.lit("coverage").alias("field_name"), cov.cast("double").alias("value"), quantiles.quantize_count(cov).alias("leaf"))),
        F.when(
            level.between(0.0, 1.0),
            F.struct(F.lit("methlevel").alias("field_name"), level.alias("value"), quantiles.quantize_unit(level).alias("leaf")),
        ),
    )
    return (
        read_table(spark, sf_dir, "methratio")
        .filter(F.col("chr").isNotNull() & F.col("context").isNotNull())
        .select("row_id", "chr", context.alias("context"), *more, F.explode(parts).alias("p"))
        .filter(F.col("p").isNotNull())
        .select("*", "p.field_name", "p.value", "p.leaf")
        .drop("p")
    )


def _percentiles(spark: SparkSession, sf_dir: str, points: list[float]) -> DataFrame:
    digests = quantiles.merge_digests(quantiles.partial_digests(_values(spark, sf_dir), KEYS, "leaf"), KEYS)
    value = F.when(F.col("field_name") == "coverage", quantiles.count_of(F.col("leaf"))).otherwise(quantiles.unit_of(F.col("leaf")))
    return quantiles.digest_percentiles(digests, KEYS, points).select(*KEYS, "point", value.alias("value"), "n")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = cut_lineage(
        _percentiles(spark, sf_dir, [0.5]).filter(F.col("n") >= CASE_ROWS).select(*[F.col(k).alias(f"m_{k}") for k in KEYS], F.col("value").alias("median"))
    )
    small = medians.count() <= MEDIANS_BROADCAST  # one row per group; beyond this the join shuffles
    rows = _values(spark, sf_dir)
    at = [F.col(k) == F.col(f"m_{k}") for k in KEYS]
    case = F.when(F.col("field_name") == "coverage", F.col("value") > 10 * F.col("median")).otherwise(F.col("value") - F.col("median") > 0.4)
    return rows.join(F.broadcast(medians) if small else medians, at).filter(case).select("row_id", "field_name")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per group; each is within half a per cent of its rank."""
    return _percentiles(spark, sf_dir, [0.05, 0.25, 0.5, 0.75, 0.95])


def p3_daily_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests made per library, compressed and then combined: the medians over all of them."""
    keys = ("library_id", *KEYS)
    own = _values(spark, sf_dir, F.coalesce("library_id", F.lit("")).alias("library_id"))
    stored = quantiles.recompress(quantiles.merge_digests(quantiles.partial_digests(own, keys, "leaf"), keys), keys)
    return quantiles.digest_percentiles(quantiles.merge_digests(stored, KEYS), KEYS, [0.5]).select(*KEYS, "leaf", "n")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether their ids decode to their text again."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("stored"))
    decoded = tokens.decode_corpus(p6_ids(spark, sf_dir), "doc_id", tokens.piece_table(spark))
    return documents.join(decoded, "doc_id").groupBy((F.col("stored") == F.col("text")).alias("same")).agg(F.count("*").alias("n"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite: its items, how many leaked, and in how many documents."""
    items = read_table(spark, sf_dir, "eval_items").select("item_id", "suite")
    return (
        items.join(p7_found(spark, sf_dir), "item_id", "left")
        .groupBy("suite")
        .agg(
            F.countDistinct("item_id").alias("n_items"),
            F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("n_leaked"),
            F.countDistinct("doc_id").alias("n_documents"),
        )
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_texts(read_table(spark, sf_dir, "documents")).select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_by_source(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_group_sizes, p3_found, p3_percentiles, p3_daily_merge, p6_ids, p6_round_trip, p7_found, p7_suites, p8_found, p8_sources)
}

_COUNTING = """v AS (SELECT row_id, chr, upper(trim(context)) AS context, coverage, methlevel FROM methratio
    WHERE chr IS NOT NULL AND context IS NOT NULL),
  x AS (SELECT row_id, 'coverage' AS field_name, chr, context, coverage::DOUBLE AS value FROM v WHERE coverage >= 0
    UNION ALL SELECT row_id, 'methlevel', chr, context, methlevel FROM v WHERE methlevel >= 0 AND methlevel <= 1 AND NOT isnan(methlevel))"""

# Labels spread over links to greater ids only: from the least member of a group on, they reach all of it.
_GROUPS = """r AS (SELECT a AS v, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.v WHERE e.b > r.g),
  found AS (SELECT min(g) AS group_id, v AS varid FROM r GROUP BY v)"""
_LINKS = """k AS (SELECT coalesce('id ' || frag_id, to_json(alist)::VARCHAR) AS f, unnest(alist) AS c FROM hapfragments),
  m AS (SELECT DISTINCT f, c.varid AS v FROM k WHERE c.allele IN ('0', '1') AND c.varid IN (SELECT varid FROM readvariant)
    UNION ALL SELECT DISTINCT 'block ' || blocks, varid FROM readvariant WHERE blocks <> 0 AND varid IS NOT NULL),
  s AS (SELECT v, min(v) OVER (PARTITION BY f) AS h FROM m), e AS (SELECT v AS a, h AS b FROM s WHERE v <> h UNION SELECT h, v FROM s WHERE v <> h)"""

SQL = {
    "p2_found": f"WITH RECURSIVE {_LINKS}, {_GROUPS} SELECT group_id, varid FROM found",
    "p2_group_sizes": f"""WITH RECURSIVE {_LINKS}, {_GROUPS}, n AS (SELECT count(*) AS n_members FROM found GROUP BY group_id)
      SELECT n_members, count(*) AS n_groups FROM n GROUP BY n_members""",
    "p3_found": f"""WITH {_COUNTING}, m AS (SELECT field_name, chr, context, quantile_disc(value, 0.5) AS med FROM x
      GROUP BY ALL HAVING count(*) >= {CASE_ROWS})
    SELECT row_id, x.field_name FROM x JOIN m ON x.field_name = m.field_name AND x.chr = m.chr AND x.context = m.context
    WHERE CASE WHEN x.field_name = 'coverage' THEN value > 10 * med ELSE value - med > 0.4 END""",
}
