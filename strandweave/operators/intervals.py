"""Interval operators: covered periods and the gaps between them.

Overlapping intervals are merged by Spark's ``session_window``: a position is taken as a second, an interval of
``n`` bases as a session whose gap is ``n`` seconds, so that sessions which overlap are merged natively.

Scale: sessions are built per (key, bin of positions), never per key. A bin holds at most ``bin_width`` different
start positions, and rows are reduced to one per start (its longest interval) with map-side aggregation before the
bin is formed, so no task gets an unbounded group even if one key holds most rows. What crosses the borders of bins
is settled on one summary row per bin.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN_WIDTH = 1 << 18


def attach(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, joined on ``names``; null keys match null keys."""
    other = right.withColumnsRenamed({n: f"_x{n}" for n in names})
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_x{n}")) for n in names])
    return left.join(other, same, how).drop(*[f"_x{n}" for n in names])


def covered_heads(
    df: DataFrame, keys: Sequence[str], start: str, span: str, bin_width: int = BIN_WIDTH
) -> DataFrame:
    """One row per maximal covered period: keys, ``_start``, ``_end`` and ``_before``, the end of the period before
    it (null for the first). Intervals cover ``start .. start + span - 1``; touching ones belong together.

    Rows with a null or non-positive start or span are left out; null keys form a key of their own. Repeated rows
    change nothing, an empty input gives an empty result, and only the named columns are read.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    starts = (
        df.select(
            *[F.col(k).alias(n) for k, n in zip(keys, names)],
            F.col(start).cast("long").alias("_s"),
            F.col(span).cast("long").alias("_n"),
        )
        .filter((F.col("_s") > 0) & (F.col("_n") > 0))
        .withColumn("_bin", F.floor(F.col("_s") / bin_width))
        .groupBy(*names, "_bin", "_s")
        .agg(F.max("_n").alias("_n"))
    )
    session = F.session_window(
        F.timestamp_seconds("_s"),
        F.make_interval(secs=F.col("_n").cast("decimal(18,6)")),
    )
    local = (
        starts.groupBy(*names, "_bin", session.alias("_w"))
        .agg(F.count("*").alias("_rows"))
        .select(
            *names,
            "_bin",
            F.col("_w.start").cast("long").alias("_s"),
            (F.col("_w.end").cast("long") - 1).alias("_e"),
        )
    )
    # What earlier bins of the key reach: one row per bin.
    bins = local.groupBy(*names, "_bin").agg(F.max("_e").alias("_reach"))
    earlier = Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = bins.select(*names, "_bin", F.max("_reach").over(earlier).alias("_carry"))
    in_bin = Window.partitionBy(*names, "_bin").orderBy("_s")
    heads = (
        attach(local, carry, [*names, "_bin"])
        .withColumn("_inside", F.max("_e").over(in_bin.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_before", F.greatest("_carry", "_inside"))
        .filter(F.col("_before").isNull() | (F.col("_s") > F.col("_before") + 1))
        .withColumn("_next", F.lead("_before").over(in_bin))
    )
    # The last period of a bin ends where the first period of a later bin says, or with the key's last base.
    first = heads.groupBy(*names, "_bin").agg(F.min_by("_before", "_s").alias("_first"))
    later = Window.partitionBy(*names).orderBy("_bin").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*names)
    ends = attach(bins, first, [*names, "_bin"], "left").select(
        *names,
        "_bin",
        F.coalesce(F.first("_first", ignorenulls=True).over(later), F.max("_reach").over(whole)).alias("_close"),
    )
    return attach(heads, ends, [*names, "_bin"]).select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        F.col("_s").alias("_start"),
        F.coalesce("_next", "_close").alias("_end"),
        "_before",
    )


def periods_and_gaps(
    df: DataFrame, keys: Sequence[str], start: str, span: str, bin_width: int = BIN_WIDTH
) -> DataFrame:
    """Keys, ``kind`` (``period`` or ``gap``), ``start_pos`` and ``end_pos``, both ends inclusive. A gap lies between
    two periods of its key; there is none before the first or after the last."""
    heads = covered_heads(df, keys, start, span, bin_width)
    parts = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_start").alias("start_pos"), F.col("_end").alias("end_pos")),
        F.when(
            F.col("_before").isNotNull(),
            F.struct(
                F.lit("gap").alias("kind"),
                (F.col("_before") + 1).alias("start_pos"),
                (F.col("_start") - 1).alias("end_pos"),
            ),
        ),
    )
    return (
        heads.select(*keys, F.explode(parts).alias("_p"))
        .filter(F.col("_p").isNotNull())
        .select(*keys, "_p.kind", "_p.start_pos", "_p.end_pos")
    )


def covered_bases(df: DataFrame, keys: Sequence[str], start: str, span: str, bin_width: int = BIN_WIDTH) -> DataFrame:
    """Keys, ``n_periods`` and ``covered_bp``: how many bases of the key lie in at least one interval."""
    return covered_heads(df, keys, start, span, bin_width).groupBy(*keys).agg(
        F.count("*").alias("n_periods"), F.sum(F.col("_end") - F.col("_start") + 1).alias("covered_bp")
    )
