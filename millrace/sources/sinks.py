"""Writing documents, snapshots, statistics and batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.sequence import with_place

FORMATS = ("jsonl", "parquet", "dataset")


def write_documents(df: DataFrame, path: str, kind: str = "jsonl", mode: str = "overwrite") -> None:
    """A directory of files; dataset is parquet too, which any reader of saved datasets takes."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    (df.write.mode(mode).option("ignoreNullFields", "false").json if kind == "jsonl" else df.write.mode(mode).parquet)(path)


def snapshot(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """df, or if a folder is given its written copy, which cuts lineage."""
    if folder is None:
        return df
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, local or wherever else Spark's file systems reach."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_file(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def write_stats(stats: DataFrame | dict, path: str, spark: SparkSession | None = None) -> dict:
    """One row of statistics as a JSON file."""
    data = stats if isinstance(stats, dict) else json.loads(stats.limit(1).toJSON().first() or "{}")
    spark = spark or (stats.sparkSession if isinstance(stats, DataFrame) else SparkSession.getActiveSession())
    write_file(spark, path, json.dumps(data, indent=2, ensure_ascii=False))
    return data


def write_mix_stats(stats: DataFrame, path: str, key: str = "domain") -> dict:
    """The statistics of a mixture, one row for each of its domains, as one JSON file by domain."""
    data = {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in stats.orderBy(key).collect()}  # as many rows as domains
    write_file(stats.sparkSession, path, json.dumps(data, indent=2, ensure_ascii=False))
    return data


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.left("key", F.lit(2)), 16, 10).cast("int"), F.lit(shards))


def cache_table(df: DataFrame, key: str, text: str, folder: str, shards: int = 16) -> DataFrame:
    """Sanitised texts by the first digits of the key's digest, written once; an empty text is a negative result."""
    rows = df.select(F.md5(F.col(key).cast("string")).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows.withColumn("shard", _shard(shards)).write.mode("overwrite").partitionBy("shard").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def cached(df: DataFrame, key: str, folder: str, make: Callable[[DataFrame], Column], shards: int = 16) -> DataFrame:
    """df with `sanitised`: looked up in the cache below folder by the key; only rows whose key is not
    there are made and added to it. make gives the column from a frame with the columns of df."""
    rows = df.withColumn("_key", F.md5(F.col(key).cast("string")))
    try:
        known = df.sparkSession.read.parquet(folder)
        todo = rows.join(known.select(F.col("key").alias("_key")), "_key", "left_anti")
    except AnalysisException:
        todo = rows
    new = todo.withColumn("_text", F.coalesce(make(todo), F.lit(""))).select(F.col("_key").alias("key"), F.col("_text").alias("text")).dropDuplicates(["key"])
    new.withColumn("shard", _shard(shards)).write.mode("append").partitionBy("shard").parquet(folder)
    known = df.sparkSession.read.parquet(folder).select(F.col("key").alias("_key"), F.col("text").alias("sanitised")).dropDuplicates(["_key"])
    return rows.join(known, "_key", "left").drop("_key")


def batch_numbers(df: DataFrame, order: str, size: int, part: str | None = None) -> DataFrame:
    """df with `batch`: rows of a part in order, `size` to a batch; without a part over all rows, whose
    places come from the counts of range partitions."""
    if part is None:
        return with_place(df, order).withColumn("batch", F.floor(F.col("_place") / size).cast("int")).drop("_place", "_all")
    w = Window.partitionBy(part).orderBy(order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def batches(df: DataFrame, size: int) -> Iterator[pa.RecordBatch]:
    """Record batches of `size` rows for a trainer, the last one shorter, fetched partition by partition as Arrow."""

    def packed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for at in range(0, b.num_rows, max(size, 1024)):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as w:
                    w.write_batch(b.slice(at, max(size, 1024)))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    held: list[pa.RecordBatch] = []
    for row in df.mapInArrow(packed, "rows binary").toLocalIterator(prefetchPartitions=True):
        held += pa.ipc.open_stream(bytes(row["rows"])).read_all().to_batches()
        while sum(b.num_rows for b in held) >= size:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield whole.slice(0, size).combine_chunks().to_batches()[0]
            held = whole.slice(size).combine_chunks().to_batches()
    if rest := [b for b in held if b.num_rows]:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
