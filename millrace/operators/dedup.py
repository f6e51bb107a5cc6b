"""Exact and near deduplication that keeps the first of its like.

"First" is by an explicit order column. Near-duplicates are pairs whose sets of runs of n characters
have a Jaccard similarity of at least t; the survivors are chosen greedily in order: a row is dropped
exactly if it is similar to an earlier row that is kept (not: if it is connected to one).

Null and empty texts are never compared: exact_dedup drops them, near_dedup drops them and counts
them in dedup_stats. Ties in the order column are broken by the key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, LongType

from millrace.functions.arrow import shingles
from millrace.functions.chars import let, words
from millrace.functions.groups import pairs_within, text_ids, with_text_id
from millrace.functions.rolling import code_points, mix, rolling
from millrace.functions.similar import SEARCHES, minima, similar_runs, similar_texts
from millrace.session import cut

MERSENNE = (1 << 31) - 1


def digest(c: Column | str, method: str = "sha256") -> Column:
    if method == "md5":
        return F.md5(c)
    if method == "sha1":
        return F.sha1(c)
    if method in ("sha256", "sha512"):
        return F.sha2(c, int(method[3:]))
    raise ValueError(f"unknown hash {method}")


def exact_dedup(df: DataFrame, text: str = "text", order: str = "ord", method: str = "sha256") -> DataFrame:
    """The first row of every different text, all columns.

    The first order value of a text is found by an aggregation, which combines copies before the
    shuffle; a text of which a third of all rows are copies is one row by then.
    """
    rows = df.where(F.length(text) > 0).withColumn("_h", digest(text, method))
    first = rows.groupBy("_h").agg(F.min(order).alias("_first"))
    return rows.join(first, (rows["_h"] == first["_h"]) & (rows[order] == first["_first"]), "left_semi").drop("_h")


def signature(sets: Column | str, hashes: int = 128) -> Column:
    """One-permutation MinHash signature of arrays of 64-bit hashes: the least of each of `hashes` ranges; null for an empty set."""

    @F.arrow_udf(ArrayType(LongType()))
    def run(column: pa.Array) -> pa.Array:
        found = [None if not v.is_valid or not len(v.values) else np.sort(v.values.to_numpy(zero_copy_only=False).view(np.uint64)) for v in column]
        return pa.array([None if h is None else (minima(h, hashes) >> np.uint64(1)).view(np.int64) for h in found], pa.list_(pa.int64()))

    return run(sets)


def _shifted_minima(hashes: np.ndarray, places: int) -> np.ndarray:
    """min over 32-bit hashes h of (h + i * 0x9e3779b9) mod 2^32 for each place i.

    The least of h + s mod 2^32 is that of the first h from 2^32 - s on, in order round the circle.
    """
    h = np.unique(hashes)
    shift = (np.arange(places, dtype=np.uint64) * np.uint64(0x9E3779B9)) & np.uint64(0xFFFFFFFF)
    at = np.searchsorted(h, (np.uint64(1 << 32) - shift) & np.uint64(0xFFFFFFFF)) % len(h)
    return (h[at] + shift) & np.uint64(0xFFFFFFFF)


def bloom_signature(text: Column | str, n: int = 13, bands: int = 20, rows: int = 6, compat: bool = False) -> Column:
    """Signature of additive shifts of one 32-bit hash per run of n characters. compat takes the last 32
    bits of SHA-256 of the run, one digest for each; else the hash is a rolling one of all runs at once."""
    import hashlib

    def by_digest(t: str) -> np.ndarray:
        runs = {t[i : i + n] for i in range(max(1, len(t) - n + 1))}
        return np.array([int.from_bytes(hashlib.sha256(r.encode("utf-8", "surrogatepass")).digest()[-4:]) for r in runs], np.uint64)

    def by_rolling(t: str) -> np.ndarray:
        return rolling(code_points(t), min(n, len(t))) & np.uint64(0xFFFFFFFF)

    hashes = by_digest if compat else by_rolling

    @F.arrow_udf(ArrayType(LongType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_shifted_minima(hashes(t), bands * rows).astype(np.int64) if t else None for t in texts.to_pylist()], pa.list_(pa.int64()))

    return run(text)


def byte_signature(text: Column | str, n: int = 5, hashes: int = 128, seed: int = 42) -> Column:
    """MinHash of byte runs: each run of n UTF-8 bytes is hashed by xor-then-multiply modulo 2^31 - 1, and
    place i is the least of (a_i h + b_i) modulo 2^31 - 1. The a and b are drawn from the seed."""

    @F.arrow_udf(ArrayType(LongType()))
    def run(texts: pa.Array) -> pa.Array:
        g = np.random.default_rng(seed)
        a, b = g.integers(1, MERSENNE, hashes, np.int64).astype(np.uint64), g.integers(0, MERSENNE, hashes, np.int64).astype(np.uint64)
        out = []
        for t in texts.to_pylist():
            h = byte_run_hashes((t or "").encode("utf-8", "surrogatepass"), n)
            if not len(h):
                out.append(None)
                continue
            low = np.full(hashes, MERSENNE, np.uint64)
            for at in range(0, len(h), 4096):
                low = np.minimum(low, ((h[at : at + 4096, None] * a[None, :] + b[None, :]) % np.uint64(MERSENNE)).min(axis=0))
            out.append(low.astype(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    return run(text)


def byte_run_hashes(raw: bytes, n: int) -> np.ndarray:
    """Distinct hashes of the runs of n bytes, one vector step a byte; fewer bytes are one run.

    Fixed values: the 32-bit offset basis and prime of FNV-1a and the modulus 2^31 - 1.
    """
    points = np.frombuffer(raw, np.uint8).astype(np.uint64)
    if not len(points):
        return points
    n = min(n, len(points))
    h = np.full(len(points) - n + 1, 2166136261, np.uint64)
    for i in range(n):
        h = ((h ^ points[i : len(points) - n + 1 + i]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    return np.unique(h % np.uint64(MERSENNE))


def estimated_jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of equal places of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(common / union)


@cache
def bands_and_rows(t: float, hashes: int = 128, steps: int = 200) -> tuple[int, int]:
    """The split of a signature that makes false positives plus false negatives at t least likely."""
    best = (math.inf, 1, 1)
    x = (np.arange(steps) + 0.5) / steps
    for b in range(1, hashes + 1):
        for r in range(1, hashes // b + 1):
            p = 1 - (1 - x**r) ** b
            error = (p[x < t].sum() + (1 - p[x >= t]).sum()) / steps
            best = min(best, (error, b, r))
    return best[1], best[2]


@cache
def finding_bands(t: float, hashes: int = 128, loss: float = 1e-4) -> tuple[int, int]:
    """The split with most rows a band that misses a pair at t with a probability of at most loss.

    What it finds too much is left to the verification. At 0.8: 25 bands of 5 rows, loss 5e-5, where
    bands_and_rows() has 9 of 13 and finds 0.40, 0.69 at 0.85 and 0.93 at 0.9.
    """
    fit = [r for r in range(1, hashes + 1) if (1 - t**r) ** (hashes // r) <= loss]
    r = max(fit, default=1)
    return hashes // r, r


def band_pairs(rows: DataFrame, key: str, order: str, sig: str, bands: int, per_band: int) -> DataFrame:
    """(lo, hi): pairs of rows that agree in all values of at least one band, lo earlier than hi; hot buckets meet in blocks."""
    parts = F.array(*[F.xxhash64(F.lit(i), F.slice(sig, i * per_band + 1, per_band)) for i in range(bands)])
    buckets = rows.where(F.col(sig).isNotNull()).select(F.struct(order, key).alias("at"), F.posexplode(parts).alias("band", "bucket"))
    return pairs_within(cut(buckets), ["band", "bucket"], "at").distinct().toDF("lo", "hi")


def _verify(pairs: DataFrame, rows: DataFrame, key: str, order: str, t: float) -> DataFrame:
    sets = rows.select(F.struct(order, key).alias("at"), "runs")
    met = pairs.join(sets.toDF("lo", "a"), "lo").join(sets.toDF("hi", "b"), "hi")
    return met.withColumn("jaccard", jaccard("a", "b")).where(F.col("jaccard") >= t).select("lo", "hi", "jaccard")


def prefix_pairs(rows: DataFrame, key: str, order: str, t: float) -> DataFrame:
    """(lo, hi, jaccard): all pairs with a similarity of at least t, exactly.

    A set of n runs in a global order can only reach t with another if they share one of its first
    n - ceil(t n) + 1 runs. The order is by rarity, so what is common to many texts is in no prefix.
    """
    sets = rows.select(F.struct(order, key).alias("at"), "runs")
    each = sets.select("at", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    often = each.groupBy("run").agg(F.count("*").alias("df"))
    ranked = each.join(often.where("df > 1"), "run").groupBy("at").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "run"))).alias("ranked"))
    # runs that no other text has come first in the order; they only use up places of the prefix
    alone = F.col("n") - F.size("ranked")
    places = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * F.lit(t) - 1e-9).cast("int") + 1 - alone)
    prefix = ranked.select("at", "n", F.explode(F.slice(F.col("ranked.run"), F.lit(1), places)).alias("run"))
    a, b = prefix.toDF("lo", "na", "run"), prefix.toDF("hi", "nb", "run")
    pairs = a.join(b, "run").where((F.col("lo") < F.col("hi")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(t) - 1e-9)).select("lo", "hi").distinct()
    return _verify(pairs, rows, key, order, t)


def _named(pairs: DataFrame, ats: DataFrame) -> DataFrame:
    """(lo, hi, jaccard) for pairs (a, b, jaccard) of ids and (tid, at), one `at` an id."""
    met = pairs.join(ats.toDF("a", "x"), "a").join(ats.toDF("b", "y"), "b")
    return met.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "jaccard")


def similar_pairs(df: DataFrame, key: str = "doc_id", order: str | None = None, text: str = "text", n: int = 13, t: float = 0.8, method: str = "exact", hashes: int = 128) -> DataFrame:
    """(lo, hi, jaccard) with lo and hi structs of order and key.

    method: exact (all pairs by prefixes, without any loss; shuffles every run and compares ever more pairs,
    for moderate corpora), minhash (one-permutation minima, tiled and verified; fed is the same), thorough
    (three independent searches of minhash, see similar.py: a pair at 0.8 is lost with probability 2e-14),
    minhash_compat (bands of the described split, which loses most pairs at t) or lshbloom (candidates of
    20 bands of 6 shifted minima, verified).
    """
    order = order or key
    one = df.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(text).alias("text"))
    if method in ("minhash", "fed", "thorough"):
        rows, ids = text_ids(one)
        ats = ids.select("tid", F.struct("ord", "key").alias("id"))
        pairs = cut(similar_texts(rows, n, t, _searches(method)))
        first = ats.groupBy("tid").agg(F.min("id").alias("at"))
        # equal texts are compared once; their rows come back at the end
        apart = _named(pairs, first) if ats.count() == first.count() else expand_pairs_with(pairs, ats)
        same = pairs_within(ats, ["tid"], "id").select(F.col("a").alias("lo"), F.col("b").alias("hi"), F.lit(1.0).alias("jaccard"))
        return apart.unionByName(same)
    rows = one.withColumn("runs", shingles("text", n))
    if method == "exact":
        return prefix_pairs(rows.select("key", "ord", "runs"), "key", "ord", t)
    if method == "minhash_compat":
        b, r = bands_and_rows(t, hashes)
        sig = rows.withColumn("sig", signature("runs", hashes))
    elif method == "lshbloom":
        b, r = 20, 6
        sig = one.withColumn("sig", bloom_signature("text", n, b, r))
    else:
        raise ValueError(f"unknown method {method}")
    pairs = cut(band_pairs(sig.select("key", "ord", "sig"), "key", "ord", "sig", b, r))
    return _verify(pairs, rows.select("key", "ord", "runs"), "key", "ord", t)


def _searches(method: str) -> int:
    return SEARCHES if method == "thorough" else 1


def expand_pairs_with(pairs: DataFrame, ats: DataFrame) -> DataFrame:
    """(lo, hi, jaccard) for pairs (a, b, jaccard) of ids and all rows (tid, id) of each."""
    scored = pairs.select("a", "b", "jaccard")
    met = scored.join(ats.toDF("a", "x"), "a").join(ats.toDF("b", "y"), "b")
    return met.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "jaccard")


def greedy_survivors(pairs: DataFrame) -> DataFrame:
    """(dup, kept) of verified pairs (lo, hi): every dropped node and the first kept node it is similar to.

    Rounds over the pair graph only: an open node with a kept earlier neighbour is dropped, one with
    none that is kept or open is kept. Each round is written once, so lineage stays short.
    """
    pairs = cut(pairs.select("lo", "hi"))
    later = pairs.select(F.col("hi").alias("at")).distinct().withColumn("state", F.lit("open"))
    first = pairs.select(F.col("lo").alias("at")).distinct().join(later, "at", "left_anti").withColumn("state", F.lit("kept"))
    nodes = cut(first.unionByName(later))
    while not nodes.where("state = 'open'").isEmpty():
        before = pairs.join(nodes.withColumnRenamed("at", "lo"), "lo").groupBy(F.col("hi").alias("at")).agg(F.max(F.col("state") == "kept").alias("kept"), F.max(F.col("state") == "open").alias("open"))
        decided = F.when(F.col("state") != "open", F.col("state")).when(F.col("kept"), "dropped").when(F.col("open"), "open").otherwise("kept")
        nodes = cut(nodes.join(before, "at", "left").select("at", decided.alias("state")))
    kept = nodes.where("state = 'kept'").select(F.col("at").alias("lo"))
    dropped = nodes.where("state = 'dropped'").select(F.col("at").alias("hi"))
    by = pairs.join(kept, "lo", "left_semi").join(dropped, "hi", "left_semi")
    return by.groupBy(F.col("hi").alias("dup")).agg(F.min("lo").alias("kept"))


def duplicate_map(pairs: DataFrame) -> DataFrame:
    """(dup_id, kept_id, jaccard) of verified pairs (lo, hi, jaccard)."""
    pairs = cut(pairs)
    found = greedy_survivors(pairs)
    return found.join(pairs.withColumnsRenamed({"hi": "dup", "lo": "kept"}), ["dup", "kept"]).select(F.col("dup.key").alias("dup_id"), F.col("kept.key").alias("kept_id"), "jaccard")


METHODS = ("exact_hash", "minhash", "minhash_compat", "fed", "thorough", "lshbloom", "exact", "both")


def near_dedup(df: DataFrame, method: str = "minhash", key: str = "doc_id", order: str | None = None, text: str = "text", n: int = 13, threshold: float = 0.8, hashes: int = 128) -> DataFrame:
    """The surviving rows of df, all columns. both is minhash, which compares equal texts once anyway."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    order = order or key
    rows = df.where(F.length(text) > 0)
    if method == "exact_hash":
        return exact_dedup(rows, text, order)
    if method in ("minhash", "fed", "both", "thorough"):
        one, ids = text_ids(rows.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(text).alias("text")))
        # a copy is similar to its first row, which decides for it
        first = cut(ids.groupBy("tid").agg(F.min(F.struct("ord", "key")).alias("at")))
        pairs = cut(similar_texts(one, n, threshold, _searches(method)))
        if pairs.isEmpty():
            kept = first.select("at.key")
        else:
            gone = greedy_survivors(_named(pairs, first)).select(F.col("dup.key").alias("key"))
            kept = first.select("at.key").join(gone, "key", "left_anti")
        return rows.join(kept.withColumnRenamed("key", key), key, "left_semi")
    first = exact_dedup(rows, text, order)
    gone = greedy_survivors(similar_pairs(first, key, order, text, n, threshold, method, hashes)).select(F.col("dup.key").alias(key))
    return first.join(gone, key, "left_anti")


def dedup_stats(df: DataFrame, kept: DataFrame, text: str = "text", compat: bool = False) -> DataFrame:
    """One row: total, kept, empty and duplicate rows, and the share of duplicates; with compat empty rows count as duplicates."""
    total = df.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.length(text), F.lit(0)) == 0).alias("empty"))
    left = kept.agg(F.count("*").alias("kept"))
    # both sides are one row
    both = total.withColumn("one", F.lit(1)).join(left.withColumn("one", F.lit(1)), "one").drop("one")
    dup = F.col("total") - F.col("kept") - (F.lit(0) if compat else F.col("empty"))
    return both.withColumn("duplicates", dup).withColumn("duplicate_share", F.coalesce(F.try_divide(dup.cast("double"), F.col("total")), F.lit(0.0)))


def filter_megabytes(bands: int, capacity: int) -> float:
    """Memory of the band filters: ten bits for each of `capacity` entries of each band."""
    return bands * capacity * 10 / 8 / (1 << 20)


def timed(name: str, df: DataFrame) -> DataFrame:
    """(stage, rows, seconds): df run once to the end on the executors, its rows counted, nothing kept."""
    import time

    begin = time.perf_counter()
    rows = df.count()
    return df.sparkSession.createDataFrame([(name, rows, time.perf_counter() - begin)], "stage string, rows long, seconds double")


def word_shingles(c: Column | str, n: int = 5) -> Column:
    """Distinct runs of n words, joined by blanks; fewer words are one run."""
    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - n + 1, F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))

    return let(words(F.lower(c)), runs)


def article_duplicates(df: DataFrame, key: str, order: str, text: str = "text", n: int = 5, t: float = 0.8, hashes: int = 128, verify: bool = True) -> DataFrame:
    """(key) of articles that are copies of, or by runs of n words similar to, an earlier kept one.

    n=13 is the described sanitiser's rule, by which one changed word breaks 13 runs.
    verify=False takes a shared band of the described split for similarity, as the described sanitiser does.
    """
    first = exact_dedup(df, text, order)
    named = first.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(text).alias("text"), F.transform(word_shingles(text, n), lambda s: F.xxhash64(s)).alias("runs"))
    if verify:
        sets = cut(with_text_id(named).select("tid", F.struct("ord", "key").alias("at"), "runs"))
        pairs = _named(cut(similar_runs(sets, t)), sets.select("tid", "at"))
    else:
        b, r = bands_and_rows(t, hashes)
        pairs = band_pairs(named.select("key", "ord", signature("runs", hashes).alias("sig")), "key", "ord", "sig", b, r)
    copies = df.where(F.length(text) > 0).select(key).join(first.select(key), key, "left_anti")
    return copies.union(greedy_survivors(pairs).select(F.col("dup.key").alias(key)))


def band_sketch(rows: DataFrame, sig: str, bands: int, per_band: int, expected: int = 100_000, error: float = 0.001) -> DataFrame:
    """(band, bits, hashes, filter): a Bloom filter per band, merged by bitwise or of the parts' filters.

    The filter's size is fixed by expected and error, whatever the number of rows.
    """
    bits = 1 << max(10, math.ceil(math.log2(-expected * math.log(error) / math.log(2) ** 2)))
    k = max(1, round(bits / expected * math.log(2)))
    parts = F.array(*[F.xxhash64(F.lit(i), F.slice(sig, i * per_band + 1, per_band)) for i in range(bands)])
    each = rows.where(F.col(sig).isNotNull()).select(F.posexplode(parts).alias("band", "bucket"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, np.ndarray] = {}
        for b in batches:
            band, bucket = b.column("band").to_numpy(), b.column("bucket").to_numpy().view(np.uint64)
            for i in range(k):
                at = mix(bucket + np.uint64(i)) & np.uint64(bits - 1)
                for one in np.unique(band):
                    f = filters.setdefault(int(one), np.zeros(bits // 8, np.uint8))
                    w = at[band == one]
                    np.bitwise_or.at(f, (w >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (w & np.uint64(7))).astype(np.uint8))
        for one, f in filters.items():
            yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([f.tobytes()], pa.binary())], names=["band", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, np.ndarray] = {}
        for b in batches:
            for one, part in zip(b.column("band").to_pylist(), b.column("part").to_pylist()):
                f = np.frombuffer(part, np.uint8)
                filters[one] = f if one not in filters else filters[one] | f
        for one, f in filters.items():
            yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([bits], pa.int32()), pa.array([k], pa.int32()), pa.array([f.tobytes()], pa.binary())], names=["band", "bits", "hashes", "filter"])

    return each.mapInArrow(fill, "band int, part binary").repartition("band").mapInArrow(merge, "band int, bits int, hashes int, filter binary")
