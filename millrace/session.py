"""Reading tables, folders for intermediate data, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A table of at most this many bytes of files may be dealt out to all cores: a shuffle of fixed cost.
SMALL_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as its scan gives it; one of at most SMALL_BYTES in fewer files than there are cores
    (test data: one row group cannot be split) is dealt out to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SMALL_BYTES and len(df.inputFiles()) < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a temporary folder on a local
    master that names none, an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df once into the shared checkpoint folder and read it from there."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def cut_freed(df: DataFrame) -> DataFrame:
    """cut(df), after which the shuffles it was made from are deleted at once, not when the driver collects its garbage."""
    out = cut(df)
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(True)
    return out
