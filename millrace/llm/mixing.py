"""Problem 3: mixing sources to target weights.

Temperature mixing. With natural shares s (of the sizes) and target shares q (of the weights) the
family p_i ~ s_i (q_i / s_i)^x runs from the natural mixture (x=0, every source repeated equally) to
the target (x=1). A source is repeated p_i * M / size_i times, M the mixture's size, so the largest
repetition grows with x, and x is bisected to the largest value that keeps the limit. Given an
entropy instead, p_i ~ s_i^x and x is bisected for it. The normalised p are the mixture: shares add
up to 1, so what a source cannot use goes to the others. Where even x=0 breaks the limit, every
source is taken as often as it may be. Sources repeated beyond the limit at x=1 cannot reach their
share. With how="weights" the reachable sources keep the ratios of their weights instead, and only
the others are held at the limit; both are the same where all shares can be reached (x=1).

The normalised weights are realised by budgeted block permutations: a source with a budget of c
sizes and a rest gives every document c times, and the rest from a seeded permutation of blocks of
documents, whole blocks until the budget ends within one, whose documents are then taken in seeded
order where they fit. Blocks are ordered by their permuted number in two steps, sums of ranges of
numbers first, so neither documents nor blocks of a source meet in one task.

Defined cases: names are compared in lower case without surrounding blanks; null and zero weights
get nothing; a repeated row of a mixture counts once; a source without documents gets nothing and
is reported; documents of null or zero size, and those without a key, are never taken but harmless; an empty corpus gives
every weighted source as unreachable only if the mixture's size is above 0, so none; an unknown mix
name (a source row without a row in mixes) is left out.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut

BLOCK_ROWS, RANGES = 2048, 1024
PLAN = T.StructType([
    T.StructField("mix", T.StringType()), T.StructField("name", T.StringType()), T.StructField("share", T.DoubleType()),
    T.StructField("size", T.LongType()), T.StructField("wanted", T.DoubleType()), T.StructField("repeats", T.DoubleType()),
    T.StructField("reachable", T.BooleanType()), T.StructField("exponent", T.DoubleType()), T.StructField("tempered", T.DoubleType()),
    T.StructField("budget", T.DoubleType()), T.StructField("passes", T.IntegerType()), T.StructField("rest", T.DoubleType()),
])


def plain_name(c) -> F.Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def bisect(low: float, high: float, good, steps: int = 60) -> float:
    """The largest x between low and high for which good(x), where good holds up to some point."""
    if good(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


def tempered(natural: list[float], target: list[float], x: float) -> list[float]:
    """Shares ~ s (q/s)^x, normalised; sources without documents or weight get 0."""
    raw = [s * (q / s) ** x if s > 0 and q > 0 else 0.0 for s, q in zip(natural, target)]
    total = sum(raw)
    return [r / total if total else 0.0 for r in raw]


def entropy(p: list[float]) -> float:
    return -sum(x * math.log(x) for x in p if x > 0)


def entropy_exponent(natural: list[float], wanted: float) -> float:
    """Exponent x in [0, 1] for which shares ~ s^x have the wanted entropy, as near as it can be."""
    flat = [1.0 if s > 0 else 0.0 for s in natural]
    powered = lambda x: tempered(natural, flat, 1 - x)  # noqa: E731  (s (1/s)^(1-x) = s^x)
    return bisect(0.0, 1.0, lambda x: entropy(powered(x)) >= wanted)


def level(weights: list[float], most: list[float], total: float) -> list[float]:
    """Parts of total in the ratio of the weights, none above its most; what one cannot take the others share."""
    out, active = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0]
    while active:
        scale = (total - sum(out)) / sum(weights[i] for i in active)
        full = [i for i in active if scale * weights[i] >= most[i]]
        if not full:
            for i in active:
                out[i] = scale * weights[i]
            break
        for i in full:
            out[i] = most[i]
        active = [i for i in active if i not in full]
    return out


def plan_mixture(rows: list[tuple[str, float, int]], total: int, factor: float, limit: int, how: str = "limit", entropy_share: float | None = None) -> list[dict]:
    """Plan of one mixture from (name, weight, size of its documents).

    how: limit (the exponent that keeps the repetition limit), entropy (the exponent for entropy_share
    of the largest entropy, that of equal shares, held at the limit) or weights.
    """
    if how not in ("limit", "entropy", "weights"):
        raise ValueError(f"unknown way {how}")
    weights = sum(w for _, w, _ in rows)
    if not weights or not rows:
        return []
    size_all = sum(s for _, w, s in rows if w > 0)
    target = [w / weights for _, w, _ in rows]
    natural = [s / size_all if size_all and w > 0 else 0.0 for _, w, s in rows]
    mixture = factor * total
    most = [float(limit) * s for _, _, s in rows]

    def repeats(x: float) -> list[float]:
        return [p * mixture / s if s else 0.0 for p, (_, _, s) in zip(tempered(natural, target, x), rows)]

    if how == "entropy":
        flat = [1.0 if s > 0 else 0.0 for s in natural]
        x = entropy_exponent(natural, (entropy_share if entropy_share is not None else 0.95) * math.log(max(1, sum(s > 0 for s in natural))))
        soft = tempered(natural, flat, 1 - x)
    else:
        x = bisect(0.0, 1.0, lambda v: max(repeats(v), default=0.0) <= limit)
        soft = tempered(natural, target, x)
    budgets = level(target if how == "weights" else soft, most, mixture)
    out = []
    for (name, _, size), share, p, budget in zip(rows, target, soft, budgets):
        wanted = share * mixture  # the size at x=1, whether or not the others can use theirs
        passes = min(int(budget // size), limit) if size else 0
        out.append({
            "name": name, "share": share, "size": size, "wanted": wanted, "repeats": wanted / size if size else None,
            "reachable": not (share > 0 and wanted > limit * size), "exponent": x, "tempered": p,
            "budget": budget, "passes": passes, "rest": budget - passes * size if size and passes < limit else 0.0,
        })
    return out


def mixing_plan(documents: DataFrame, sources: DataFrame, mixes: DataFrame, source: str = "source", size: str = "n_chars", how: str = "limit", entropy_share: float | None = None) -> DataFrame:
    """One row for each source of each mixture (PLAN). The corpus is reduced to one size per source
    named in `sources`, a table of fixed length; only these sizes reach the driver."""
    spark = documents.sparkSession
    named = sources.select("mix", plain_name("name").alias("name"), "subset", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    named = named.where("name IS NOT NULL").distinct().groupBy("mix", "name").agg(F.sum("weight").alias("weight")).join(mixes.select("mix", "size_factor", "max_repeats"), "mix")
    rows = named.collect()
    names = spark.createDataFrame([(n,) for n in sorted({r["name"] for r in rows})], "name string")
    docs = documents.select(plain_name(source).alias("name"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    # sizes of the named sources, and of all the rest in one row: as many rows as there are names
    sizes = docs.join(F.broadcast(names.withColumn("known", F.lit(True))), "name", "left").groupBy(F.when(F.col("known"), F.col("name")).alias("name")).agg(F.sum("size").alias("size")).collect()
    of = {r["name"]: r["size"] or 0 for r in sizes}
    total = sum(of.values())
    by_mix: dict[str, list] = defaultdict(list)
    for r in rows:
        by_mix[r["mix"], r["size_factor"], r["max_repeats"]].append((r["name"], r["weight"], of.get(r["name"], 0)))
    out = []
    for (mix, factor, limit), given in sorted(by_mix.items(), key=str):
        out += [{"mix": mix} | p for p in plan_mixture(sorted(given), total, factor or 0.0, limit or 0, how, entropy_share)]
    return spark.createDataFrame([tuple(p[f.name] for f in PLAN) for p in out], PLAN)


def unreachable(plan: DataFrame) -> DataFrame:
    return plan.where("NOT reachable").select("mix", "name")


def _fill(seed: int):
    def take(block):
        """Documents of the block in seeded order, each taken if it still fits the budget."""
        block = block.assign(at=pd.util.hash_array(block["key"].to_numpy("uint64") ^ np.uint64(seed))).sort_values(["at", "key"])
        left, more = block["left"].iloc[0], []
        for size in block["size"]:
            more.append(int(size <= left))
            left -= size if size <= left else 0
        return block.assign(more=more)[["mix", "name", "block", "key", "size", "passes", "left", "state", "more"]]

    return take


def realise(documents: DataFrame, plan: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_chars", seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(mix, name, key, size, copies): how often each mixture takes each document, at least once."""
    docs = documents.select(F.col(key).cast("long").alias("key"), plain_name(source).alias("name"), F.col(size).cast("long").alias("size")).where("size > 0 AND key IS NOT NULL")
    names = F.broadcast(plan.select("name").distinct())  # as many as the fixed table of sources has
    docs = docs.join(names, "name")
    blocks = docs.groupBy("name").agg(F.greatest(F.ceil(F.count("*") / F.lit(block_rows)), F.lit(1)).alias("blocks"))
    docs = docs.join(F.broadcast(blocks), "name").withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")))
    shares = F.broadcast(plan.where("budget > 0 AND size > 0").select("mix", "name", "passes", "rest"))
    totals = docs.groupBy("name", "block").agg(F.sum("size").alias("in_block")).join(shares, "name")
    # the permuted number of a block; sums of ranges of numbers first, then of the blocks within a range
    totals = cut(totals.withColumn("at", F.xxhash64("block", "mix", F.lit(seed)))).withColumn("range", F.floor(F.col("at") / F.lit((1 << 64) // RANGES)))
    so_far = Window.partitionBy("mix", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.groupBy("mix", "name", "range").agg(F.sum("in_block").alias("in_range")).withColumn("before", F.coalesce(F.sum("in_range").over(so_far), F.lit(0)))
    order = Window.partitionBy("mix", "name", "range").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("in_it", F.sum("in_block").over(order)).join(ranges.drop("in_range"), ["mix", "name", "range"])
    totals = totals.withColumn("upto", F.col("before") + F.col("in_it"))
    # blocks that fit whole; of the one in which the budget ends, what is left for it
    totals = totals.withColumn("left", F.col("rest") - (F.col("upto") - F.col("in_block")))
    totals = totals.withColumn("state", F.when(F.col("in_block") <= F.col("left"), "whole").when(F.col("left") > 0, "part").otherwise("none"))
    totals = totals.where("passes > 0 OR state <> 'none'")
    taken = docs.join(totals.select("mix", "name", "block", "passes", "left", "state"), ["name", "block"])
    part = taken.where("state = 'part'").groupBy("mix", "name", "block").applyInPandas(
        _fill(seed), "mix string, name string, block long, key long, size long, passes int, left double, state string, more int"
    )
    rest = taken.select("mix", "name", "block", "key", "size", "passes", "left", "state").where("state <> 'part'").withColumn("more", (F.col("state") == "whole").cast("int"))
    both = rest.unionByName(part).withColumn("copies", F.col("passes") + F.col("more")).where("copies > 0")
    return both.select("mix", "name", F.col("key").alias(key), "size", "copies")


def actual_shares(realised: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of a mixture: target share, planned share, what was taken, its share, the largest repetition."""
    got = realised.groupBy("mix", "name").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies"))
    rows = plan.select("mix", "name", "share", "tempered", "exponent", "wanted", "budget", "reachable").join(got, ["mix", "name"], "left")
    rows = rows.fillna({"taken": 0, "most_copies": 0})
    of_all = F.sum("taken").over(Window.partitionBy("mix"))  # a row for each source of a mixture
    return rows.withColumn("actual_share", F.try_divide(F.col("taken"), of_all))
