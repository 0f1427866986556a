"""Streaming forms: event-time windows and sessions with watermarks, and mates paired as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.session import checkpoint_dir

LATE = "10 minutes"


def windowed_counts(stream: DataFrame, at: str, key: str, value: str, width: str, late: str = LATE) -> DataFrame:
    """Rows and sum per key and tumbling window; rows later than ``late`` are dropped."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("w"), key)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start_at"), key, "n", "total")
    )


def session_counts(stream: DataFrame, at: str, keys: list[str], gap: str, late: str = LATE) -> DataFrame:
    """Sessions per key: a molecule's reads, or a user's events, with gaps below ``gap``. State is kept per open session."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.session_window(at, gap).alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(*keys, F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n")
    )


def paired_mates(first: DataFrame, second: DataFrame, key: str, at: str, within: str, late: str = LATE) -> DataFrame:
    """First and second mates of a stream joined by name; a mate waits for the other for ``within``, not for ever."""
    left = first.withWatermark(at, late).withColumnsRenamed({c: f"first_{c}" for c in first.columns if c != key})
    right = second.withWatermark(at, late).withColumnsRenamed({c: f"second_{c}" for c in second.columns if c != key} | {key: "_key"})
    near = F.expr(f"second_{at} BETWEEN first_{at} - INTERVAL {within} AND first_{at} + INTERVAL {within}")
    return left.join(right, (F.col(key) == F.col("_key")) & near).drop("_key")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def run_to_table(result: DataFrame, base: str | None = None) -> DataFrame:
    """Runs a stream over what is there, adding rows as the watermark closes their windows, and gives the rows as a table
    in the shared folder. A stream with the same ``base`` goes on where it stopped. A batch that is run again after a
    failure replaces its own folder, so no row comes twice; windows that are still open stay in the state."""
    spark = result.sparkSession
    base = base or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")

    query = result.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
