"""Reading tables, and cutting lineage in the folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder is made only for a local master without one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new name in the shared checkpoint folder, deleted with the session's JVM."""
    name = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    fs, path = _path(spark, name)
    fs.deleteOnExit(path)
    return name


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read from there, so that it survives lost executors.

    A table, not ``checkpoint()``: that computes the last stage twice, and in loops it keeps the constraints of all
    earlier plans, which the optimizer then multiplies. The table goes with ``release`` or with the session's JVM.
    """
    spark = df.sparkSession
    name = shared_path(spark, "cut")
    df.write.parquet(name)
    out = spark.read.schema(df.schema).parquet(name)
    out._cut_name = name
    return out


def cut_counted(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage``, and aggregates over the rows, taken while they are written instead of by a job of their own."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, *[c.alias(n) for n, c in measures.items()]))
    return out, seen.get


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames of ``cut_lineage`` that nothing reads any more."""
    for df in frames:
        name = getattr(df, "_cut_name", None)
        if name:
            fs, path = _path(df.sparkSession, name)
            fs.delete(path, True)
