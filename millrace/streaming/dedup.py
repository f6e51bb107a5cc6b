"""Streams of documents: stateless stages, exact and near deduplication, windows on event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.groups import sent, with_text_id
from millrace.functions.rolling import mix
from millrace.functions.runs import column
from millrace.functions.similar import RADIUS, band_rows, near_by_sketch, shingle_sets, verified
from millrace.operators.cleaning import clean
from millrace.operators.dedup import greedy_survivors
from millrace.operators.filters import heuristic_filter
from millrace.session import cut


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def stateless(df: DataFrame, text: str = "text") -> DataFrame:
    """Cleaning and heuristic reasons: the batch expressions as they are."""
    return heuristic_filter(df.withColumn(text, clean(F.col(text))), text)


def _timed(df: DataFrame, time: str) -> DataFrame:
    """A watermark needs a timestamp with a time zone."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def exact_stream(df: DataFrame, text: str = "text", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each text. With an event time the state of a text is dropped after the delay;
    without one it grows with the number of different texts."""
    rows = df.where(F.length(text) > 0).withColumn("_h", F.sha2(text, 256))
    if event_time is None:
        return rows.dropDuplicates(["_h"]).drop("_h")
    return _timed(rows, event_time).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def event_windows(df: DataFrame, time: str, width: str, slide: str | None = None, delay: str = "10 minutes", by: str | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums) per window of event time; late rows beyond the delay are left out."""
    keys = [F.window(time, width, slide) if slide else F.window(time, width)] + ([F.col(by)] if by else [])
    aggregates = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return _timed(df, time).withWatermark(time, delay).groupBy(*keys).agg(*aggregates)


def sessions(df: DataFrame, time: str, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    return _timed(df, time).withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


class NearDedupSink:
    """foreachBatch sink that keeps a document unless it is similar to an earlier kept one.

    State lies below `folder`: the kept documents, and their band rows (key, size, sketch, id), both in
    directories by batch number and by the slot of the key or id. A batch reads only the slots its own
    keys fall into, and of these only what meets its keys; the runs of stored documents are read only
    for candidates. A repeated batch overwrites its own part and sees only the parts before it.

    With filter_bits each batch also leaves a Bloom filter of its keys, of a fixed size; keys that no
    earlier filter knows are not looked for. What a batch keeps is also written as JSON lines below
    `jsonl`, if that is given, in a directory of its own, after the stages of `later`.
    """

    def __init__(self, folder: str, key: str, order: str, text: str = "text", n: int = 13, t: float = 0.8, slots: int = 64, filter_bits: int = 0, jsonl: str | None = None, later: Callable[[DataFrame], DataFrame] | None = None):
        self.folder, self.key, self.order, self.text, self.n, self.t = folder, key, order, text, n, t
        self.slots, self.filter_bits, self.jsonl, self.later = slots, filter_bits, jsonl, later

    def _stored(self, spark: SparkSession, name: str, before: int | None = None) -> DataFrame | None:
        try:
            rows = spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None
        return rows if before is None else rows.where(F.col("batch") < before)

    def kept(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """What (earlier) batches kept; None while there is nothing."""
        rows = self._stored(spark, "kept", before)
        return None if rows is None else rows.drop("batch", "slot", "_tid")

    def _slot(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.slots)).cast("int")

    def _slots_of(self, rows: DataFrame, c: str) -> list[int]:
        return sorted(r[0] for r in rows.select(self._slot(c)).distinct().collect())  # at most as many as there are slots

    def _known(self, bands: DataFrame, number: int) -> DataFrame:
        """The band rows whose keys some filter of an earlier batch may hold."""
        if not self.filter_bits:
            return bands
        parts = self._stored(bands.sparkSession, "filters", number)
        if parts is None:
            return bands.limit(0)
        merged = merge_filters(parts.select("part"))
        if merged is None:
            return bands.limit(0)
        return maybe_in_filter(bands, bands.sparkSession.sparkContext.broadcast(merged), self.filter_bits)

    def _seen(self, rows: DataFrame, bands: DataFrame, number: int) -> DataFrame | None:
        """(tid) of the rows (tid, value) similar to a stored one."""
        spark = rows.sparkSession
        old = self._stored(spark, "bands", number)
        if old is None:
            return None
        mine = cut(self._known(bands, number))
        near = old.where(F.col("slot").isin(self._slots_of(mine, "key"))).selectExpr("key", "n AS m", "tid AS old", "s0 AS t0", "s1 AS t1")
        met = near.join(sent(mine), "key").where(F.least("n", "m") >= F.lit(self.t) * F.greatest("n", "m"))
        met = met.where(F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) <= RADIUS)
        pairs = cut(met.select(F.col("old").alias("a"), F.col("tid").alias("b")).distinct())
        if pairs.isEmpty():
            return None
        ids = pairs.select(F.col("a").alias("tid")).distinct()
        kept = self._stored(spark, "kept", number)
        texts = kept.where(F.col("slot").isin(self._slots_of(ids, "tid"))).select(F.col("_tid").alias("tid"), F.col(self.text).alias("value"))
        found = verified(pairs.where("a <> b"), rows.unionByName(texts.join(sent(cut(ids)), "tid", "left_semi")), shingle_sets(self.n), self.t)
        return found.select(F.col("b").alias("tid")).union(pairs.where("a = b").select("b")).distinct()  # equal texts have equal ids

    def __call__(self, batch: DataFrame, number: int) -> None:
        one = with_text_id(batch.where(F.length(self.text) > 0), self.text, "_tid")
        first = one.groupBy("_tid").agg(F.min(F.struct(self.order, self.key)).alias("_at"))
        rows = cut(one.join(first, "_tid").where(F.struct(self.order, self.key) == F.col("_at")).dropDuplicates(["_tid"]))
        values = rows.select(F.col("_tid").alias("tid"), F.col(self.text).alias("value"))
        bands = cut(band_rows(values, shingle_sets(self.n)))
        seen = self._seen(values, bands, number)
        if seen is not None:
            rows = cut(rows.join(seen.withColumnRenamed("tid", "_tid"), "_tid", "left_anti"))
            bands = cut(bands.join(seen, "tid", "left_anti"))
        # among the batch itself, in order
        pairs = cut(verified(cut(near_by_sketch(bands, self.t)), rows.select(F.col("_tid").alias("tid"), F.col(self.text).alias("value")), shingle_sets(self.n), self.t))
        ats = rows.select("_tid", "_at")
        named = pairs.join(ats.toDF("a", "x"), "a").join(ats.toDF("b", "y"), "b").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
        gone = cut(greedy_survivors(named).select(F.col("dup").alias("_at")))
        rows = rows.join(gone, "_at", "left_anti")
        bands = bands.join(rows.select(F.col("_tid").alias("tid")), "tid", "left_semi")
        name = f"batch={number:09d}"
        bands.withColumn("slot", self._slot("key")).write.mode("overwrite").partitionBy("slot").parquet(f"{self.folder}/bands/{name}")
        if self.filter_bits:
            filter_parts(bands, self.filter_bits).write.mode("overwrite").parquet(f"{self.folder}/filters/{name}")
        out = rows.drop("_at")
        if self.jsonl:
            rows = out.drop("_tid")
            (self.later(rows) if self.later else rows).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{self.jsonl}/{name}")
        out.withColumn("slot", self._slot("_tid")).write.mode("overwrite").partitionBy("slot").parquet(f"{self.folder}/kept/{name}")


def _places(keys: np.ndarray, bits: int, i: int) -> np.ndarray:
    return (mix(keys.view(np.uint64) + np.uint64(i)) % np.uint64(bits)).astype(np.int64)


FILTER_HASHES = 4


def filter_parts(bands: DataFrame, bits: int) -> DataFrame:
    """(part): a Bloom filter of the keys of each partition, of `bits` bits."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.zeros(bits, bool)
        for b in batches:
            for i in range(FILTER_HASHES):
                f[_places(column(b, "key"), bits, i)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(f).tobytes()], pa.binary())], names=["part"])

    return bands.select("key").mapInArrow(fill, "part binary")


def merge_filters(parts: DataFrame) -> bytes | None:
    """The filters of all parts as one; merged within partitions first, one filter of a partition comes to the driver at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            for part in b.column("part").to_pylist():
                one = np.frombuffer(part, np.uint8)
                f = one.copy() if f is None else np.bitwise_or(f, one, out=f)
        if f is not None:
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes()], pa.binary())], names=["part"])

    total = None
    for r in parts.mapInArrow(merge, "part binary").coalesce(8).mapInArrow(merge, "part binary").toLocalIterator():
        one = np.frombuffer(bytes(r["part"]), np.uint8)
        total = one.copy() if total is None else total | one
    return None if total is None else total.tobytes()


def maybe_in_filter(bands: DataFrame, merged: Broadcast, bits: int) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.unpackbits(np.frombuffer(merged.value, np.uint8))[:bits].astype(bool)
        for b in batches:
            hit = np.ones(b.num_rows, bool)
            for i in range(FILTER_HASHES):
                hit &= f[_places(column(b, "key"), bits, i)]
            yield b.filter(pa.array(hit))

    return bands.mapInArrow(keep, bands.schema)


def near_stream(df: DataFrame, sink: NearDedupSink, checkpoint: str):
    """Runs through all input there is and stops; started again with the same checkpoint it goes on."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def jsonl_stream(df: DataFrame, path: str, checkpoint: str, text: str = "text"):
    """Clean, filter and append rows as JSON lines as they arrive, each exactly once; started again it goes on."""
    rows = stateless(df, text).where("reject_reason IS NULL").drop("features", "reject_reason")
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("ignoreNullFields", "false").trigger(availableNow=True).start()
