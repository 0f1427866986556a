"""Range joins by bins, depth, sessions and islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.intervals import attach

BIN = 1000


def bin_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], pos: str, start: str, end: str, bin_width: int = BIN, how: str = "inner"
) -> DataFrame:
    """Each row of ``points`` with each row of ``intervals`` of the same keys whose ``start`` .. ``end`` holds ``pos``.

    An interval has a row for each bin it touches, a point for its own, so a pair meets exactly once. The shuffle is by
    keys and bin: a key with most rows is spread over its bins, and a deep bin is left to AQE's skew join. Column names
    other than the keys must differ.
    """
    wide = intervals.filter(F.col(end) >= F.col(start)).withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor(F.col(end) / bin_width)))
    )
    own = points.withColumn("_bin", F.floor(F.col(pos) / bin_width)).withColumnsRenamed({k: f"_p{k}" for k in keys})
    at = [F.col(f"_p{k}") == F.col(k) for k in keys] + [own["_bin"] == wide["_bin"], F.col(pos).between(F.col(start), F.col(end))]
    joined = own.join(wide, at, how)
    return joined.drop(own["_bin"]).drop(wide["_bin"], *([f"_p{k}" for k in keys] if how == "inner" else []))


def depth_runs(intervals: DataFrame, keys: Sequence[str], start: str, end: str, bin_width: int = 1 << 18) -> DataFrame:
    """Keys, ``start_pos``, ``end_pos`` and ``depth`` of maximal runs of positions with the same depth above 0, cut at
    multiples of ``bin_width``.

    Intervals are cut at bin borders and become events of +1 and -1, summed per position before the running sum, so a
    window holds at most the different positions of one bin.
    """
    cut = (
        intervals.filter(F.col(end) >= F.col(start))
        .withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor(F.col(end) / bin_width))))
        .select(
            *keys,
            "_bin",
            F.greatest(F.col(start), F.col("_bin") * bin_width).alias("_s"),
            F.least(F.col(end) + 1, (F.col("_bin") + 1) * bin_width).alias("_e"),
        )
    )
    events = cut.select(*keys, "_bin", F.explode(F.array(F.struct(F.col("_s").alias("p"), F.lit(1).alias("d")), F.struct(F.col("_e").alias("p"), F.lit(-1).alias("d")))).alias("_v"))
    sums = events.groupBy(*keys, "_bin", F.col("_v.p").alias("p")).agg(F.sum("_v.d").alias("d")).filter("d <> 0")
    w = Window.partitionBy(*keys, "_bin").orderBy("p")
    return (
        sums.withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("end_pos", F.lead("p").over(w) - 1)
        .filter("depth > 0")
        .select(*keys, F.col("p").alias("start_pos"), "end_pos", "depth")
    )


def running_total(df: DataFrame, keys: Sequence[str], at: str, value: Column, name: str, bin_width: int) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows of the key up to and with this row's ``at``.

    Rows are ordered per bin of ``at`` and the bins of a key on one row each, so a key with most rows is not ordered in
    one task.
    """
    rows = df.withColumn("_bin", F.floor(F.col(at) / bin_width)).withColumn("_v", value)
    sums = rows.groupBy(*keys, "_bin").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_bin", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    return attach(rows, carry, [*keys, "_bin"]).withColumn(name, F.col("_carry") + F.sum("_v").over(inside)).drop("_bin", "_v", "_carry")


def previous(df: DataFrame, keys: Sequence[str], at: str, column: str, name: str, bin_width: int) -> DataFrame:
    """``df`` with ``name``, the ``column`` (without nulls) of the row before by ``at``; null for the key's first row. Ordered
    in bins like ``running_total``."""
    rows = df.withColumn("_bin", F.floor(F.col(at) / bin_width))
    last = rows.groupBy(*keys, "_bin").agg(F.max_by(column, at).alias("_l"))
    carry = last.select(*keys, "_bin", F.lag("_l").over(Window.partitionBy(*keys).orderBy("_bin")).alias("_carry"))
    inside = F.lag(column).over(Window.partitionBy(*keys, "_bin").orderBy(at))
    return attach(rows, carry, [*keys, "_bin"]).withColumn(name, F.coalesce(inside, F.col("_carry"))).drop("_bin", "_carry")


def sessions(df: DataFrame, keys: Sequence[str], at: str, gap: int) -> DataFrame:
    """``df`` with ``session_id``, counted per key from 1: a new one starts where ``at`` is more than ``gap`` after the row
    before. Ordered in bins of 64 gaps."""
    width = 64 * max(1, gap)
    rows = previous(df, keys, at, at, "_prev", width)
    new = F.when(F.col(at) - F.col("_prev") <= gap, 0).otherwise(1)
    return running_total(rows, keys, at, new, "session_id", width).drop("_prev")


def runs(df: DataFrame, keys: Sequence[str], at: str, step: int = 1) -> DataFrame:
    """``df`` with ``run_id``: rows whose ``at`` follows the row before by ``step`` share it (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) == step, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
