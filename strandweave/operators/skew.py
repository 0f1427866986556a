"""Per-key results where a few keys hold most rows.

Rows are compressed to (key, value, weight) first. That grouping is spread over the values of a hot key, is reduced
on the map side, and what is left per key depends on its different values, not on its rows. Everything per key is
then derived from the weights: row counts, exact distinct counts, sums, modes and percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

BUCKETS = 1024


def value_frequencies(df: DataFrame, key: Column | str, value: Column | str) -> DataFrame:
    """``key``, ``value`` and ``weight``, the number of rows with both. Null keys and values are kept as such."""
    key, value = (F.col(x) if isinstance(x, str) else x for x in (key, value))
    return df.select(key.alias("key"), value.alias("value")).groupBy("key", "value").agg(F.count("*").alias("weight"))


def summarize_keys(freq: DataFrame) -> DataFrame:
    """Per key: ``n_rows``, ``n_values`` (exact distinct, nulls apart), ``total`` (sum of values) and ``mode`` (the
    least of the most frequent values; null if all are null). Null keys are left out."""
    w, v = F.col("weight"), F.col("value")
    known = F.when(v.isNotNull(), F.struct(w.alias("w"), (-v).alias("v")))
    return (
        freq.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.sum(w).alias("n_rows"),
            F.count(v).alias("n_values"),
            F.sum(v * w).alias("total"),
            F.max(known).alias("_m"),
        )
        .select("key", "n_rows", "n_values", "total", (-F.col("_m.v")).alias("mode"))
    )


def weighted_percentiles(freq: DataFrame, points: Sequence[float], bucket: int = BUCKETS) -> DataFrame:
    """``key``, ``point`` and ``value``: the least value with at least ``point`` of the key's non-null rows at or
    below it. Exact.

    Two levels: weights are summed per key and bucket of values, the bucket that holds each rank is found on those
    sums, and only the values of that bucket are ordered. A window so sees at most the buckets of a key or the
    values of one bucket. Whole numbers are put into buckets of ``bucket`` values, others into ``bucket`` for each power
    of two. NaN counts as no value.
    """
    v = F.col("value")
    if isinstance(freq.schema["value"].dataType, (DoubleType, FloatType)):
        power = F.floor(F.log2(F.abs(v)))
        spread = F.floor((power + 1100 + F.abs(v) / F.pow(F.lit(2.0), power) - 1) * bucket)
        number = F.when(v == 0, 0).when(v > 0, spread).otherwise(-spread)
        freq = freq.filter(~F.isnan("value"))
    else:
        number = F.floor(v / bucket)
    known = freq.filter(F.col("key").isNotNull() & v.isNotNull()).withColumn("_b", number.cast("long"))
    sums = known.groupBy("key", "_b").agg(F.sum("weight").alias("_w"))
    upto = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        sums.withColumn("_to", F.sum("_w").over(upto))
        .withColumn("_n", F.sum("_w").over(Window.partitionBy("key")))
        .withColumn("point", F.explode(F.array(*[F.lit(float(p)) for p in points])))
        .withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("point") * F.col("_n"))))
        .filter((F.col("_rank") <= F.col("_to")) & (F.col("_rank") > F.col("_to") - F.col("_w")))
        .select(
            F.col("key").alias("_k"), F.col("_b").alias("_kb"), "point", (F.col("_rank") - F.col("_to") + F.col("_w")).alias("_r")
        )
    )
    inside = Window.partitionBy("key", "_b", "point").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        known.join(ranked, (F.col("key") == F.col("_k")) & (F.col("_b") == F.col("_kb")))
        .withColumn("_to", F.sum("weight").over(inside))
        .filter((F.col("_r") <= F.col("_to")) & (F.col("_r") > F.col("_to") - F.col("weight")))
        .select("key", "point", "value")
    )


def heavy_keys(freq: DataFrame, share: float) -> DataFrame:
    """``key``, ``n_rows`` and ``row_share`` of the keys that hold at least ``share`` of all rows, null keys counted
    among all rows but never reported."""
    total = freq.agg(F.sum("weight")).scalar()
    return (
        summarize_keys(freq)
        .select("key", "n_rows", (F.col("n_rows") / total).alias("row_share"))
        .filter(F.col("row_share") >= share)
    )
