"""Operators on vectors and frames: spectra, packing, quantisation, clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.functions.chars import let

EPS = 1e-8


def spectral_features(df: DataFrame, clip: str, frame: str, magnitude: str, phase: str, bands: int) -> DataFrame:
    """(clip, frame, features): per band the mean log magnitude and the mean wrapped phase step, in turn.

    Rows are (clip, frame) with one array of magnitudes and one of phases over frequencies; the last
    band takes the remainder. The first frame has phase steps of 0.
    """
    before = F.lag(phase).over(Window.partitionBy(clip).orderBy(frame))
    two_pi = 2 * math.pi

    def wrapped(a: Column, b: Column) -> Column:
        return F.pmod(a - b + F.lit(math.pi), F.lit(two_pi)) - F.lit(math.pi)

    step = F.when(before.isNull(), F.transform(F.col(phase), lambda _: F.lit(0.0))).otherwise(F.zip_with(F.col(phase), before, wrapped))
    logs = F.transform(F.col(magnitude), lambda m: F.log(m + EPS))
    rows = df.select(clip, frame, logs.alias("_l"), step.alias("_p"))
    width = F.floor(F.size("_l") / bands).cast("int")

    def mean(c: str, i: int) -> Column:
        part = F.slice(c, F.lit(i) * width + 1, F.size(c) - F.lit(i) * width if i == bands - 1 else width)
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)

    features = F.array(*[m for i in range(bands) for m in (mean("_l", i), mean("_p", i))])
    return rows.select(clip, frame, features.alias("features"))


def pack_frames(df: DataFrame, clip: str, frame: str, features: str, per: int) -> DataFrame:
    """(clip, pack, features): `per` frames joined, the last pack filled up with zeros."""
    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(clip).orderBy(frame)) - 1)
    packs = rows.groupBy(clip, F.floor(F.col("_i") / per).cast("int").alias("pack")).agg(F.array_sort(F.collect_list(F.struct("_i", features))).alias("_f"), F.first(F.size(features)).alias("_n"))
    joined = F.flatten(F.col(f"_f.{features}"))
    return packs.select(clip, "pack", F.concat(joined, F.array_repeat(F.lit(0.0), F.col("_n") * per - F.size(joined))).alias("features"))


def unpack_frames(df: DataFrame, clip: str, pack: str, features: str, per: int) -> DataFrame:
    width = F.size(features) / per
    rows = df.select(clip, pack, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.slice(features, (i * width + 1).cast("int"), width.cast("int")))).alias("_k", "features"))
    return rows.select(clip, (F.col(pack) * per + F.col("_k")).alias("frame"), "features")


def packed_length(samples: int | Column, hop: int, per: int):
    """ceil(ceil(n / hop) / per), and back: per * hop * n."""
    if isinstance(samples, Column):
        return F.ceil(F.ceil(samples / hop) / per)
    return math.ceil(math.ceil(samples / hop) / per)


def unpacked_length(packs: int | Column, hop: int, per: int):
    return packs * hop * per


def quantise(df: DataFrame, vector: str, codebook: np.ndarray, out: str = "code") -> DataFrame:
    """df with the index of the nearest row of the codebook by Euclidean distance, the first on ties.

    The codebook is a model of fixed size, sent with the function. A null vector has a null code.
    """
    book = np.asarray(codebook, np.float64)
    half = (book * book).sum(axis=1)
    fields = list(df.columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(vector)
            codes = np.zeros(b.num_rows, np.int32)
            good = np.array([v.is_valid for v in values], bool) if values.null_count else np.ones(b.num_rows, bool)
            if good.any():
                x = values.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(good.sum()), -1)
                codes[good] = (half[None, :] - 2 * x @ book.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, mask=~good)], names=[*fields, out])

    return df.mapInArrow(rows, StructType([*df.schema.fields, StructField(out, IntegerType())]))


def dequantise(df: DataFrame, code: str, codebook: DataFrame) -> DataFrame:
    """df joined with its codebook rows (code, vector); a codebook has a fixed number of rows."""
    return df.join(F.broadcast(codebook), code, "left")


def reconstruct(df: DataFrame, clip: str, frame: str, log_magnitude: str, phase_step: str) -> DataFrame:
    """(clip, frame, magnitude, phase): exp of the logs, running sum of the phase steps."""
    running = F.sum(phase_step).over(Window.partitionBy(clip).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0))
    return df.select(clip, frame, F.exp(log_magnitude).alias("magnitude"), running.alias("phase"))


def k_means(df: DataFrame, vector: str, k: int, seed: int = 42, rounds: int = 100, tolerance: float = 1e-4, order: str | None = None) -> np.ndarray:
    """Lloyd's algorithm: k rows chosen by hash begin; empty centres stay; stops when they move less than tolerance.

    Each round is one aggregation of k rows of sums over all rows.
    """
    key = F.xxhash64(F.col(order) if order else F.col(vector), F.lit(seed))
    centres = np.array([r[0] for r in df.where(F.col(vector).isNotNull()).orderBy(key, order or key).limit(k).select(vector).collect()], np.float64)
    width = centres.shape[1]
    for _ in range(rounds):
        coded = quantise(df.select(vector).where(F.col(vector).isNotNull()), vector, centres, "_code")
        sums = coded.groupBy("_code").agg(F.count("*").alias("n"), *[F.sum(F.col(vector)[i].cast("double")).alias(f"s{i}") for i in range(width)])
        new = centres.copy()
        for r in sums.collect():  # k rows
            new[r["_code"]] = np.array([r[f"s{i}"] for i in range(width)]) / r["n"]
        moved = float(np.linalg.norm(new - centres))
        centres = new
        if moved < tolerance:
            break
    return centres


def codebook_report(coded: DataFrame, vector: str, code: str, codebook: np.ndarray) -> DataFrame:
    """One row: mean squared error and share of the codes in use."""
    spark = coded.sparkSession
    book = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(codebook)], f"{code} int, _centre array<double>")
    error = F.aggregate(F.zip_with(vector, "_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(vector)
    return dequantise(coded, code, book).agg(F.avg(error).alias("mse"), (F.count_distinct(code) / F.lit(len(codebook))).alias("used"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_pairwise_cosine(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, vectors, diversity): 1 - mean cosine of different pairs, from sums of unit vectors.

    The sum over all pairs is the squared length of the sum minus the number of vectors, so no pair
    is ever formed.
    """
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    unit = df.where(norm > 0).select(group, F.posexplode(F.transform(F.col(vector), lambda x: x.cast("double") / norm)).alias("i", "x"))
    per = unit.groupBy(group, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    out = per.groupBy(group).agg(F.max("n").alias("vectors"), F.sum(F.col("s") * F.col("s")).alias("q"))
    return out.select(group, "vectors", (1.0 - F.try_divide(F.col("q") - F.col("vectors"), F.col("vectors") * (F.col("vectors") - 1))).alias("diversity"))


def top_k(values: Column, k: int) -> Column:
    """The k largest of an array as structs (value, index), ties by index."""
    pairs = F.transform(values, lambda v, i: F.struct((-v).alias("neg"), i.alias("index"), v.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), F.lit(1), F.lit(k)), lambda p: F.struct(p["value"].alias("value"), p["index"].alias("index")))


def grouped_top_k(values: Column, groups: int, keep: int, k: int) -> Column:
    """top_k among the `keep` groups of equal width with the largest maxima."""
    width = (F.size(values) / groups).cast("int")
    best = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.array_max(F.slice(values, g * width + 1, width)))
    pairs = F.transform(values, lambda v, i: F.struct((-v).alias("neg"), i.alias("index"), v.alias("value")))
    inside = let(F.transform(top_k(best, keep), lambda p: p["index"]), lambda chosen: F.filter(pairs, lambda p: F.array_contains(chosen, F.floor(p["index"] / width).cast("int"))))
    return F.transform(F.slice(F.array_sort(inside), F.lit(1), F.lit(k)), lambda p: F.struct(p["value"].alias("value"), p["index"].alias("index")))


def softmax(values: Column) -> Column:
    def scaled(most: Column) -> Column:
        return let(F.transform(values, lambda v: F.exp(v - most)), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))

    return let(F.array_max(values), scaled)


def nucleus(values: Column, p: float) -> Column:
    """Indices, by falling value, of the smallest set whose softmax exceeds p; the crossing one is kept."""
    ranked = let(softmax(values.cast("array<double>")), lambda p: top_k(p, 1 << 30))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["sum"] + x["value"]).alias("sum"), F.when(s["sum"] <= p, F.concat(s["kept"], F.array(x["index"].cast("int")))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(ranked, start, step, lambda s: s["kept"])


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest vectors of each query by Euclidean distance, itself
    left out, ties by key. Exact.

    Queries are dealt into blocks and vectors into as many blocks of the same size; a task compares one
    block of each, by one matrix product, and gives k rows a query, of which the best are taken in the end.
    """
    n_q, n_v = queries.count(), vectors.count()
    if not n_q or not n_v:
        return queries.select(F.col(key).alias("query"), F.col(key).alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    q_blocks, v_blocks = -(-n_q // block), -(-n_v // block)

    def dealt(df: DataFrame, mine: str, blocks: int, other: str, others: int, side: int) -> DataFrame:
        rows = df.select(F.lit(side).cast("byte").alias("side"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        rows = rows.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
        return rows.select((F.col("q") * v_blocks + F.col("v_")).alias("cell"), "side", "id", "v")

    both = dealt(queries, "q", q_blocks, "v_", v_blocks, 0).unionByName(dealt(vectors, "v_", v_blocks, "q", q_blocks, 1))

    def best(cell):
        import pandas as pd

        q, v = cell[cell["side"] == 0], cell[cell["side"] == 1].sort_values("id")
        if not len(q) or not len(v):
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
        a, b = np.stack(q["v"].to_numpy()), np.stack(v["v"].to_numpy())
        ids, out = v["id"].to_numpy(), []
        d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
        for i, one in enumerate(q["id"].to_numpy()):
            row = np.where(ids == one, np.inf, d[i])
            most = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf  # all that are as near as the k-th
            at = np.flatnonzero((row <= most + 1e-9) & np.isfinite(row))
            exact = np.sqrt(((b[at] - a[i]) ** 2).sum(axis=1))
            out.append(pd.DataFrame({"query": one, "neighbour": ids[at], "distance": exact}))
        return pd.concat(out)

    found = both.groupBy("cell").applyInPandas(best, "query long, neighbour long, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
