"""Problem 7: filling containers of fixed capacity with items, splitting only items that exceed it.

Bound-certified repacking. Items are dealt into partitions by hash, each small enough for one task,
and packed by best-fit decreasing. Dual-feasible functions of the sizes give a lower bound of the
number of bins of each partition; where it is met the partition is certified. Partitions with a gap
keep their best-filled bins and exchange the documents of the others: these are pooled, dealt anew
and packed again, as long as that saves bins. A bin is a row until the end, so only its items and
sums are shuffled; the driver sees counts, and for the report a histogram of at most capacity sizes.

Defined cases: an item longer than the capacity is cut into full pieces and a rest; null and empty
texts have size 0 and are in no bin (bin is null); ties are broken by key and piece, so the result
is the same on every run; repeated rows are items of their own, rows without a key none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

CAPACITY, PART_ROWS, ROUNDS = 2048, 20_000, 4


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each of the sizes, which are in decreasing order.

    Open bins are kept in lists by free space, and the free spaces in use as bits of one integer,
    so the tightest bin that fits is the lowest bit from size on.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins, out = 0, 0, []
    for s in sizes:
        above = used >> s
        if above:
            at = s + (above & -above).bit_length() - 1
            bin_ = free[at].pop()
            if not free[at]:
                used ^= 1 << at
        else:
            at, bin_ = capacity, bins
            bins += 1
        out.append(bin_)
        if left := at - s:
            free[left].append(bin_)
            used |= 1 << left
    return out


def lower_bound(histogram: np.ndarray, capacity: int, most_k: int = 20) -> int:
    """Lower bound of the number of bins, the largest over two families of dual-feasible functions.

    histogram[s] is the number of items of size s <= capacity. f_l counts an item above capacity-l
    as 1, one below l as 0, others by size; u_k rounds (k+1) s / capacity down to k-ths unless whole.
    """
    sizes = np.arange(capacity + 1)
    weight = histogram * sizes
    best = -(-int(weight.sum()) // capacity)
    upto, count = np.cumsum(weight), np.cumsum(histogram)
    for low in range(1, capacity // 2 + 1):
        large = int(count[-1] - count[capacity - low])
        middle = int(upto[capacity - low] - upto[low - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, most_k + 1):
        x = sizes * (k + 1)
        value = np.where(x % capacity == 0, k * sizes, (x // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((histogram * value).sum()) // (k * capacity)))
    return best


def pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, start, n): an item longer than the capacity in full pieces and a rest."""
    rows = sizes.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("size"))
    rows = rows.select("key", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / F.lit(capacity)).cast("int") - 1, F.lit(0)))).alias("piece"))
    start = F.col("piece") * F.lit(capacity)
    return rows.select("key", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("size") - start).alias("n"))


def _pack(capacity: int, round_: int):
    def rows(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "key", "piece"], ascending=[False, True, True])
        sizes = part["n"].to_numpy()
        bins = np.array(best_fit_decreasing(sizes.tolist(), capacity), np.int64)
        filled = np.bincount(bins, weights=sizes).astype(np.int64)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return part.assign(bin=bins, free=(capacity - filled)[bins].astype(np.int32), bins=len(filled), bound=bound, round=round_)

    return rows


_PACKED = "key long, piece int, start int, n int, part int, bin long, free int, bins int, bound int, round int"


def _deal_and_pack(rows: DataFrame, n: int, round_: int, capacity: int, part_rows: int) -> DataFrame:
    parts = max(1, -(-n // part_rows))
    dealt = rows.select("key", "piece", "start", "n", F.pmod(F.xxhash64("key", "piece", F.lit(round_)), F.lit(parts)).cast("int").alias("part"))
    return cut(dealt.groupBy("part").applyInPandas(_pack(capacity, round_), _PACKED))


def _full_bins(full: DataFrame, part_rows: int) -> DataFrame:
    """Full pieces with a bin of their own each: below 0, by hash part and place in it."""
    n = full.count()
    parts = max(1, -(-n // part_rows))
    part = full.withColumn("part", F.pmod(F.xxhash64("key", "piece"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("key", "piece", "copy"))
    return part.select("key", "piece", "start", "n", (F.lit(-1) - F.col("part") * F.lit(1 << 24) - place).cast("long").alias("bin"))


def packed_parts(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> tuple[DataFrame, list[DataFrame]]:
    """All pieces, and the packed ones of each round (_PACKED), in which a piece is once."""
    every = cut(pieces(sizes, key, size, capacity))
    todo = every.where(F.col("n").between(1, capacity - 1))
    n = todo.count()
    done = []
    packed = _deal_and_pack(todo, n, 0, capacity, part_rows) if n else None
    for round_ in range(1, rounds + 1):
        if packed is None:
            break
        gaps = packed.groupBy("part").agg(F.first("bins").alias("x"), F.first("bound").alias("y")).where("x > y").select("part")
        loose = cut(packed.where("free > 0").join(gaps, "part", "left_semi"))  # full bins stay closed
        before = loose.select("part", "bin").distinct().count()
        if not before:
            break
        again = _deal_and_pack(loose, loose.count(), round_, capacity, part_rows)
        after = again.select("part", "bin").distinct().count()
        if after >= before:
            break
        moved = loose.select("part", "bin").distinct().hint("merge")  # a bin is opened whole
        done.append(packed.join(moved, ["part", "bin"], "left_anti").select(packed.columns))
        packed = again
    if packed is not None:
        done.append(packed)
    return every, done


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(key, piece, start, n, bin): every piece of every item with its bin, of at most capacity.

    bin is round * 2^48 + partition * 2^24 + number; full pieces are bins of their own, numbered below 0.
    """
    every, done = packed_parts(sizes, key, size, capacity, part_rows, rounds)
    number = F.lit(1 << 48) * F.col("round") + F.lit(1 << 24) * F.col("part") + F.col("bin")
    out = _full_bins(every.where(F.col("n") == capacity).withColumn("copy", F.monotonically_increasing_id()), part_rows)
    out = out.unionByName(every.where("n = 0").select("key", "piece", "start", "n", F.lit(None).cast("long").alias("bin")))
    for d in done:
        out = out.unionByName(d.select("key", "piece", "start", "n", number.cast("long").alias("bin")))
    return out.withColumnRenamed("key", key)


def part_report(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(round, part, bins, tokens, bound, gap): the bins that a partition keeps and what its own items need
    at least; gap is what is left between them when the exchange ends."""
    _, done = packed_parts(sizes, key, size, capacity, part_rows, rounds)
    bound = F.udf(lambda sizes: lower_bound(np.bincount([s for s, n in sizes for _ in range(n)], minlength=capacity + 1), capacity) if sizes else 0, "int")
    out = None
    for d in done:
        count = d.groupBy("round", "part", "n").agg(F.count("*").cast("int").alias("m"))
        need = count.groupBy("round", "part").agg(F.collect_list(F.struct("n", "m")).alias("sizes"), F.sum(F.col("n") * F.col("m")).cast("long").alias("tokens"))
        one = d.groupBy("round", "part").agg(F.count_distinct("bin").cast("int").alias("bins")).join(need, ["round", "part"])
        one = one.select("round", "part", "bins", "tokens", bound("sizes").alias("bound"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return sizes.sparkSession.createDataFrame([], "round int, part int, bins int, tokens long, bound int, gap int")
    return out.withColumn("gap", F.col("bins") - F.col("bound"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, pieces, tokens, bins, the certified lower bound of the bins and the share filled."""
    per_size = {r["n"]: r["count"] for r in packed.where("n > 0").groupBy("n").count().collect()}  # at most capacity rows
    histogram = np.array([per_size.get(s, 0) for s in range(capacity + 1)], np.int64)
    key = packed.columns[0]
    one = packed.agg(F.count_distinct(key).alias("items"), F.count("*").alias("pieces"), F.sum("n").cast("long").alias("tokens"), F.count_distinct("bin").alias("bins"))
    return one.select("*", F.lit(lower_bound(histogram, capacity)).alias("bound"), F.try_divide("tokens", F.col("bins") * F.lit(capacity)).alias("filled"))
