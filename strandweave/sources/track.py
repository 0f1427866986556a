"""Tracks: values at positions, kept as sorted Parquet files that a region query reads in part.

A track is a folder with the table ``values`` (chrom, pos, strand, context, mc, cov), written in ranges of (chrom, pos), so that the
least and greatest position of a row group let a reader leave the others out, and the tables ``zoom=N`` with the sums of
windows of ``N`` bases. A chromosome with most rows is cut into as many ranges as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZOOMS = (1000, 10_000, 100_000)
KEYS = ("strand", "context")


def write_track(rows: DataFrame, path: str, zooms: Sequence[int] = ZOOMS) -> None:
    """Rows without chrom or pos have no place in a track and are left out. Each zoom is made from the one below it."""
    values = rows.filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull()).select("chrom", F.col("pos").cast("long").alias("pos"), *KEYS, "mc", "cov")
    values.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.parquet(f"{path}/values")
    below = rows.sparkSession.read.parquet(f"{path}/values").withColumn("n", F.lit(1).cast("long"))
    for zoom in sorted(zooms):
        start = F.floor(F.col("pos") / zoom) * zoom
        sums = below.groupBy("chrom", start.alias("pos"), *KEYS).agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"), F.sum("n").alias("n"))
        sums.write.parquet(f"{path}/zoom={zoom}")
        below = rows.sparkSession.read.parquet(f"{path}/zoom={zoom}")


def read_track(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Values of a track, or of the positions ``start`` .. ``end`` of a chromosome; the limits reach the scan."""
    rows = spark.read.parquet(f"{path}/values")
    if chrom is not None:
        rows = rows.filter(F.col("chrom") == chrom)
    if start is not None:
        rows = rows.filter(F.col("pos") >= start)
    return rows if end is None else rows.filter(F.col("pos") <= end)


def read_zoom(spark: SparkSession, path: str, zoom: int) -> DataFrame:
    """Sums per window: chrom, pos (its first), strand, context, mc, cov and n, the number of values."""
    return spark.read.parquet(f"{path}/zoom={zoom}")


def chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """Chromosomes of a track with their number of values, first and last position."""
    return spark.read.parquet(f"{path}/values").groupBy("chrom").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
