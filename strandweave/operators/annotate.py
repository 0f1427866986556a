"""Profiles of sites over regions: bins along the body and the flanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.rangejoin import bin_join

LEVELS = 40
FLANK = 2000


def site_bins(regions: DataFrame, sites: DataFrame, flank: int = FLANK, levels: int = LEVELS) -> DataFrame:
    """``region_id``, ``part`` (``up``, ``body`` or ``down``) and ``bin`` of each site in or near a region.

    ``regions`` has region_id, chrom, start_pos, end_pos and strand; on the minus strand parts and bins are counted from
    the region's end. ``sites`` has chrom and pos.
    """
    wide = regions.withColumns({"_from": F.col("start_pos") - flank, "_to": F.col("end_pos") + flank})
    met = bin_join(sites, wide, ["chrom"], "pos", "_from", "_to", 10_000)
    minus = F.col("strand") == "-"
    size = F.col("end_pos") - F.col("start_pos") + 1
    before, after = F.col("pos") < F.col("start_pos"), F.col("pos") > F.col("end_pos")
    part = F.when(before, F.when(minus, "down").otherwise("up")).when(after, F.when(minus, "up").otherwise("down")).otherwise("body")
    offset = F.when(before, F.col("pos") - F.col("_from")).when(after, F.col("pos") - F.col("end_pos") - 1).otherwise(F.col("pos") - F.col("start_pos"))
    width = F.when(before | after, F.lit(flank)).otherwise(size)
    at = F.floor(offset * levels / width)
    return met.select("region_id", part.alias("part"), F.when(minus, levels - 1 - at).otherwise(at).alias("bin"))


def profile(binned: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Sites per part and bin in windows of two bins: each bin with the one before it. All bins come out."""
    counts = binned.groupBy("part", "bin").agg(F.count("*").alias("n"))
    grid = binned.sparkSession.createDataFrame([(p,) for p in ("up", "body", "down")], "part string").select(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(levels - 1).cast("long"))).alias("bin")
    )
    w = Window.partitionBy("part").orderBy("bin").rowsBetween(-1, 0)
    full = grid.join(counts, ["part", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("part", "bin", F.sum("n").over(w).alias("n_sites")).filter("bin > 0")


def region_totals(binned: DataFrame) -> DataFrame:
    """Sites per region in its three parts (a pivot over the fixed part names)."""
    return binned.groupBy("region_id").pivot("part", ["up", "body", "down"]).count().na.fill(0)


def heatmap(binned: DataFrame, levels: int = LEVELS, columns: int = 10) -> DataFrame:
    """One row per region: body sites in ``columns`` columns (a pivot over fixed numbers), and ``first_bin``, its first bin
    with a site."""
    body = binned.filter("part = 'body'").withColumn("col", F.floor(F.col("bin") * columns / levels).cast("int"))
    wide = body.groupBy("region_id").pivot("col", list(range(columns))).count().na.fill(0)
    wide = wide.withColumnsRenamed({str(i): f"b{i}" for i in range(columns)})
    first = body.groupBy("region_id").agg(F.min("bin").alias("first_bin"))
    return wide.join(first, "region_id")
