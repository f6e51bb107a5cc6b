"""Similar sets of hashes: one-permutation minima, tiled comparison of sketches, exact check.

Sets are sorted distinct 64-bit hashes, of runs of characters (similar_texts) or given as arrays
(similar_runs), one for each id `tid`. Two sets are similar from a Jaccard similarity of t on.

1. The smallest hash in each of ROWS*BANDS equal ranges of the hash space (empty ranges are filled from
   a fixed donor range) gives BANDS keys of ROWS minima and a 128-bit sketch, two bits of each of 64.
2. Rows (band key, set size, tid, sketch) are shuffled by key and sorted. The members of a key are
   compared with each other exactly, in tiles: exclusive-or of the sketches and a bit count, all pairs
   within the radius; tiles are in order of the set sizes and skipped by them. Keys with more than
   `hot` members are dealt into blocks within bands of sizes, each two of which that can have similar
   members are a group of a second shuffle.
3. The pairs left are compared by their whole sets.

A pair at exactly t=0.8 shares no key with probability (1-0.8^4)^20 = 2.6e-5. Several searches, each with
hashes mixed anew, lose only what all of them lose: SEARCHES of 3 leave 2e-14 for a pair, less than the
chance that the 64-bit hashes of two texts of 1,500 runs clash (1e-13). Ranges filled from donors are not
independent: of sets of 5 and 4 hashes a search lost 159 of 180,000 pairs (9e-4, so 7e-10 for three).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.groups import SENT_ROWS, sent
from millrace.functions.rolling import code_points, distinct_shingles, mix, rolling
from millrace.functions.runs import column, whole_runs
from millrace.session import cut, cut_freed

ROWS, BANDS, RADIUS, TILE, HOT = 4, 20, 40, 256, 4096
SEARCHES = 3
BAND_SCHEMA = "key long, n int, tid long, s0 long, s1 long"
_ROUNDS = 64
Sets = Callable[[pa.Array], list[np.ndarray]]


@cache
def _ranges(bins: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.array([(i << 64) // bins for i in range(1, bins)], np.uint64)
    return edges, np.stack([np.random.default_rng(7 + r).permutation(bins) for r in range(_ROUNDS)])


def minima(hashes: np.ndarray, bins: int = ROWS * BANDS) -> np.ndarray:
    """The smallest hash of each of the equal ranges of the hash space; hashes sorted, not empty."""
    edges, donors = _ranges(bins)
    at = np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])
    filled = at[1:] > at[:-1]
    out = hashes[np.minimum(at[:-1], len(hashes) - 1)]
    if filled.all():
        return out
    empty = np.flatnonzero(~filled)
    for r in range(_ROUNDS):
        donor = donors[r][empty]
        good = filled[donor]
        out[empty[good]] = out[donor[good]]
        empty = empty[~good]
        if not len(empty):
            return out
    out[empty] = hashes[0]
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, band keys (n x BANDS) and sketches (n x 2) of sets that are not empty."""
    n = np.array([len(s) for s in sets], np.int32)
    low = np.stack([minima(s) for s in sets])
    keys = np.full((len(sets), BANDS), 0x51ED270B, np.uint64)
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, j::ROWS])
    keys = mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64))
    two = mix(low[:, :64] + np.uint64(0x2545F4914F6CDD1D))
    bits = np.stack([two & np.uint64(1), (two >> np.uint64(1)) & np.uint64(1)], axis=2).astype(np.uint8)
    sketch = np.packbits(bits.reshape(len(sets), 128), axis=1).view(np.uint64)
    return n, keys, sketch


def shingle_sets(k: int) -> Sets:
    """Sets of the runs of k characters; a shorter text is one run."""

    def sets(texts: pa.Array) -> list[np.ndarray]:
        return [distinct_shingles(t, k) if len(t) >= k else rolling(code_points(t), len(t)) if t else np.empty(0, np.uint64) for t in texts.to_pylist()]

    return sets


def given_sets(runs: pa.Array) -> list[np.ndarray]:
    """Sets of arrays of 64-bit hashes."""
    return [np.unique(r.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)) for r in runs]


def remixed(hashes: np.ndarray, search: int) -> np.ndarray:
    """The sorted set with hashes of their own for each search; search 0 has the hashes as they are."""
    return np.sort(mix(hashes + np.uint64(search * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))) if search else hashes


def band_rows(rows: DataFrame, sets: Sets, search: int = 0) -> DataFrame:
    """BAND_SCHEMA for rows (tid, value); copies of a tid are mostly dropped, empty sets too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for b in batches:
            new = []
            for i, tid in enumerate(b.column("tid").to_pylist()):
                if tid not in seen:
                    seen[tid] = None
                    new.append(i)
            if len(seen) > 200_000:  # copies met later are dropped after the shuffle
                seen.clear()
            for at in range(0, len(new), 512):
                part = b.take(pa.array(new[at : at + 512], pa.int64()))
                found, tids = sets(part.column("value")), column(part, "tid")
                some = [i for i, s in enumerate(found) if len(s)]
                if not some:
                    continue
                n, keys, sketch = signatures([remixed(found[i], search) for i in some])
                columns = [keys.reshape(-1).view(np.int64), *(np.repeat(c, BANDS) for c in (n, tids[some], sketch[:, 0].view(np.int64), sketch[:, 1].view(np.int64)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "n", "tid", "s0", "s1"])

    return rows.mapInArrow(run, BAND_SCHEMA)


def _near(n, tid, s0, s1, i, j, t, radius):
    """Of the candidate index pairs i, j those within the radius and of fitting size."""
    fit = (np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j])) & (tid[i] != tid[j])
    i, j = i[fit], j[fit]
    d = np.bitwise_count(s0[i] ^ s0[j]) + np.bitwise_count(s1[i] ^ s1[j])
    return i[d <= radius], j[d <= radius]


def tiled_pairs(n, tid, s0, s1, start, stop, t, radius, sides=None):
    """Index pairs within rows start..stop (sorted by n) whose sketches are within the radius.

    Compares tile by tile; skips tile pairs by the populations n. With sides (0 or 1 for each row)
    only pairs of rows on different sides are given.
    """
    edges = list(range(start, stop, TILE)) + [stop]
    for x, (a, b) in enumerate(zip(edges, edges[1:])):
        for y in range(x, len(edges) - 1):
            c, d = edges[y], edges[y + 1]
            if n[b - 1] < t * n[c]:
                break  # sorted by n: no later tile fits either
            near = np.bitwise_count(s0[a:b, None] ^ s0[None, c:d])
            near += np.bitwise_count(s1[a:b, None] ^ s1[None, c:d])
            i, j = np.nonzero(near <= radius)
            i, j = i + a, j + c
            ok = i < j
            if sides is not None:
                ok &= sides[i] != sides[j]
            i, j = i[ok], j[ok]
            fit = (n[i] >= t * n[j]) & (tid[i] != tid[j])
            yield i[fit], j[fit]


def _compare(t: float, radius: int, hot: int, crossed: bool):
    """Pairs of each run of a key; rows of a hot key are handed on with kind 1."""

    def batch(kind, a, b, n, s0, s1):
        return pa.RecordBatch.from_arrays([np.full(len(a), kind, np.int8), a, b, n, s0, s1], names=["kind", "a", "b", "n", "s0", "s1"])

    def pairs(tid, i, j):
        z = np.zeros(len(i), np.int64)
        return batch(0, np.minimum(tid[i], tid[j]), np.maximum(tid[i], tid[j]), z.astype(np.int32), z, z)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = (1 << 31) if crossed else hot
        for table, is_hot in whole_runs(batches, "key", limit, ["n", "tid"]):
            key, n, tid, s0, s1 = (column(table, c) for c in ("key", "n", "tid", "s0", "s1"))
            if is_hot:
                yield batch(1, key, tid, n, s0, s1)
                continue
            s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
            sides = column(table, "side") if crossed else None
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            size = np.diff(edges)
            small = size <= 16
            if not crossed and len(key) > 1:  # all short runs at once, by distance
                left = np.repeat(np.where(small, edges[1:], 0), size) - np.arange(len(key)) - 1
                i = np.flatnonzero(left > 0)
                step = 1
                while len(i):
                    a, b = _near(n, tid, s0, s1, i, i + step, t, radius)
                    if len(a):
                        yield pairs(tid, a, b)
                    step += 1
                    i = i[left[i] >= step]
            for x in np.flatnonzero(size > 1) if crossed else np.flatnonzero(~small):
                for a, b in tiled_pairs(n, tid, s0, s1, int(edges[x]), int(edges[x + 1]), t, radius, sides):
                    if len(a):
                        yield pairs(tid, a, b)

    return rows


def near_by_sketch(bands: DataFrame, t: float = 0.8, radius: int = RADIUS, hot: int = HOT, kept=cut) -> DataFrame:
    """(a, b), a < b: pairs of tids of (key, n, tid, s0, s1) with a key in common that are near by sketch and size."""
    out = "kind byte, a long, b long, n int, s0 long, s1 long"
    first = kept(bands.repartition("key").sortWithinPartitions("key", "n", "tid").mapInArrow(_compare(t, radius, hot, False), out))
    near = first.where("kind = 0").select("a", "b")
    rows = first.where("kind = 1").selectExpr("a AS key", "b AS tid", "n", "s0", "s1")
    if not rows.isEmpty():
        # similar sizes are in the same band of sizes or in the next one
        rows = rows.withColumn("size", F.floor(F.log("n") / F.lit(1.0001 * math.log(1 / t))).cast("int"))
        count = sent(cut(rows.groupBy("key", "size").agg(F.ceil(F.count("*") / F.lit(hot / 2)).cast("int").alias("g"))))
        after, before = (count.select("key", (F.col("size") + d).alias("size"), F.col("g").alias(name)) for d, name in ((-1, "g_after"), (1, "g_before")))
        dealt = rows.join(count, ["key", "size"]).join(after, ["key", "size"], "left").join(before, ["key", "size"], "left")
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("tid", "key"), F.col("g")).cast("int"))

        def meet(other: str, g: str, low, first_block, second_block, side, inside) -> DataFrame:
            each = dealt.where(F.col(g).isNotNull()).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(g) - 1)))
            return each.select(F.xxhash64("key", *low, first_block, second_block).alias("key"), "n", "tid", "s0", "s1", side.cast("long").alias("side"), inside.alias("inside"))

        size, never = F.col("size"), F.lit(False)
        grouped = [
            meet("other", "g", (size, size), F.least("mine", "other"), F.greatest("mine", "other"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1), F.col("mine") == F.col("other")),
            meet("other", "g_after", (size, size + 1), F.col("mine"), F.col("other"), F.lit(0), never),
            meet("other", "g_before", (size - 1, size), F.col("other"), F.col("mine"), F.lit(1), never),
        ]
        blocks = grouped[0].unionByName(grouped[1]).unionByName(grouped[2])
        # inside one block every pair counts: a side of its own for each row
        blocks = blocks.withColumn("side", F.when(F.col("inside"), F.col("tid")).otherwise(F.col("side"))).drop("inside")
        blocks = blocks.repartition("key").sortWithinPartitions("key", "n", "tid")
        near = near.unionByName(blocks.mapInArrow(_compare(t, radius, hot, True), out).select("a", "b"))
    return near.distinct()


def _verify(sets: Sets, t: float):
    """Rows (a, b, value of b) sorted by a with the row of a itself first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mine = None, None
        for batch in batches:
            a, b = column(batch, "a"), column(batch, "b")
            keep, score = [], []
            for at in range(0, len(a), 256):
                for i, s in enumerate(sets(batch.column("value").slice(at, 256)), at):
                    if a[i] == b[i]:
                        head, mine = a[i], s
                    elif head == a[i]:
                        both = np.concatenate([mine, s])
                        both.sort(kind="stable")
                        common = int((both[1:] == both[:-1]).sum())
                        union = len(both) - common
                        if common >= t * union:
                            keep.append(i)
                            score.append(common / union)
            yield pa.RecordBatch.from_arrays([a[keep], b[keep], np.array(score, np.float64)], names=["a", "b", "jaccard"])

    return rows


def verified(pairs: DataFrame, rows: DataFrame, sets: Sets, t: float) -> DataFrame:
    """(a, b, jaccard) of the pairs whose whole sets are similar; rows (tid, value) may repeat a tid, pairs should be cut."""
    wanted = pairs.select("a", "b").unionByName(pairs.select("a", F.col("a").alias("b")).distinct())
    one = rows.dropDuplicates(["tid"])
    met = wanted.join(one, wanted["b"] == one["tid"]).select("a", "b", "value")
    met = met.repartition("a").sortWithinPartitions("a", (F.col("a") != F.col("b")).cast("int"))
    return met.mapInArrow(_verify(sets, t), "a long, b long, jaccard double")


def _similar(rows: DataFrame, sets: Sets, t: float, **how) -> DataFrame:
    return verified(cut(near_by_sketch(band_rows(rows, sets), t, **how)), rows, sets, t)


def _searched(rows: DataFrame, sets: Sets, t: float, searches: int, **how) -> DataFrame:
    """_similar of several searches; the shuffle of one is deleted before the next begins."""
    near = None
    for i in range(searches):
        found = near_by_sketch(band_rows(rows, sets, i), t, kept=cut_freed, **how)
        near = cut_freed(found if near is None else near.unionByName(found).distinct())
    wanted = cut(near.select(F.col("a").alias("tid")).union(near.select("b")).distinct())
    some = wanted.limit(SENT_ROWS + 1).count() <= SENT_ROWS  # texts without a partner are not shuffled
    return verified(near, rows.join(F.broadcast(wanted), "tid", "left_semi") if some else rows, sets, t)


def similar_texts(texts: DataFrame, k: int = 13, t: float = 0.8, searches: int = 1, **how) -> DataFrame:
    """(a, b, jaccard), a < b, of every two distinct texts (tid, text) with a similarity of at least t by runs of k characters."""
    rows = texts.select("tid", F.col("text").alias("value"))
    return _similar(rows, shingle_sets(k), t, **how) if searches == 1 else _searched(rows, shingle_sets(k), t, searches, **how)


def similar_runs(rows: DataFrame, t: float = 0.8, **how) -> DataFrame:
    """The same for (tid, runs), runs an array of 64-bit hashes."""
    return _similar(rows.select("tid", F.col("runs").alias("value")), given_sets, t, **how)
