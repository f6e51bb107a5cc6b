"""Domain mixtures: weights, quotas, deterministic sampling, reweighting by losses."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Domain shares of the named mixtures, each in its own order.
DOMAINS = ("common_crawl", "wikipedia", "code", "academic", "books", "news", "social")
PRESETS = {
    "default": {"common_crawl": 0.45, "wikipedia": 0.08, "books": 0.05, "academic": 0.15, "news": 0.04, "social": 0.03, "code": 0.20},
    "half_web": {"common_crawl": 0.50, "code": 0.15, "wikipedia": 0.12, "books": 0.10, "academic": 0.08, "news": 0.03, "social": 0.02},
    "balanced": {d: 1 / 7 for d in DOMAINS},
}


def resolve_weights(weights: dict[str, float] | str) -> dict[str, float]:
    """Normalised weights of a dict, a preset, or doremi (uniform)."""
    if isinstance(weights, str):
        if weights == "doremi":
            return {d: 1 / len(DOMAINS) for d in DOMAINS}
        if weights not in PRESETS:
            raise ValueError(f"unknown composition {weights}")
        weights = PRESETS[weights]
    if any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("weights must not be negative and not all 0")
    total = sum(weights.values())
    return {d: w / total for d, w in weights.items()}


def quotas(weights: dict[str, float], available: dict[str, int], total: int) -> dict[str, int]:
    """Rows for each weighted domain by largest remainder; what falls to domains without rows is given
    to the others in proportion, and the leftover to the one with the largest quota."""
    exact = {d: total * w for d, w in weights.items()}
    out = {d: math.floor(x) for d, x in exact.items()}
    place = {d: i for i, d in enumerate(weights)}
    for d in sorted(weights, key=lambda d: (-(exact[d] - out[d]), place[d]))[: total - sum(out.values())]:
        out[d] += 1
    full = {d: out[d] for d in weights if available.get(d, 0) > 0}
    loose = sum(out[d] for d in weights if d not in full)
    if not full:
        return dict.fromkeys(weights, 0)
    base = sum(full.values())
    if loose and base:
        for d in full:
            out[d] += int(loose * (full[d] / base))
        left = loose - sum(int(loose * (n / base)) for n in full.values())
        out[max(full, key=lambda d: (full[d], -place[d]))] += left
    elif loose:
        each, left = divmod(loose, len(full))
        for i, d in enumerate(full):
            out[d] += each + (i < left)
    return {d: n if d in full else 0 for d, n in out.items()}


def quota_table(spark: SparkSession, quota: dict[str, int], available: dict[str, int]) -> DataFrame:
    rows = [(d, n, int(available.get(d, 0))) for d, n in quota.items()]
    return spark.createDataFrame(rows, "domain string, quota long, available long")


def seeded(key: Column | str, seed: int, *more: Column) -> Column:
    """A hexadecimal random order that every engine computes alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), *more))


def sample(df: DataFrame, quota: DataFrame, key: str, domain: str = "domain", seed: int = 42, buckets: int = 4096) -> DataFrame:
    """df with `copies`: exactly quota rows of each domain, counted with copies, in seeded order.

    With a quota above the rows there are, every row is taken quota div rows times and the first
    quota mod rows of the order once more. Ranks come from counts per hash bucket; only the bucket in
    which the quota ends is ordered, so a domain with a third of all rows is no single task.
    """
    rows = df.join(F.broadcast(quota.where("quota > 0 AND available > 0").withColumnRenamed("domain", domain)), domain)
    rows = rows.withColumn("_at", seeded(key, seed)).withColumn("_bucket", F.pmod(F.conv(F.left("_at", F.lit(3)), 16, 10).cast("int"), F.lit(buckets)))
    whole = F.floor(F.col("quota") / F.col("available")).cast("int")
    rest = F.when(F.col("quota") > F.col("available"), F.col("quota") % F.col("available")).otherwise(F.when(F.col("quota") == F.col("available"), 0).otherwise(F.col("quota")))
    counts = rows.groupBy(domain, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(domain).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    rows = rows.join(counts, [domain, "_bucket"]).withColumn("_rest", rest).withColumn("_whole", whole)
    inside = (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_n") > F.col("_rest"))
    edge = rows.where(inside).withColumn("_rank", F.row_number().over(Window.partitionBy(domain, "_bucket").orderBy("_at", key)))
    edge = edge.withColumn("_more", (F.col("_before") + F.col("_rank") <= F.col("_rest")).cast("int"))
    clear = rows.where(~inside).withColumn("_rank", F.lit(0)).withColumn("_more", (F.col("_before") + F.col("_n") <= F.col("_rest")).cast("int"))
    out = clear.unionByName(edge).withColumn("copies", F.col("_whole") + F.col("_more")).where("copies > 0")
    return out.select(*df.columns, "copies")


def expand(sampled: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One row per copy with `copy` (from 1) and `place`, the seeded hash to sort by for a shuffle."""
    rows = sampled.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.withColumn("place", seeded(key, seed, F.col("copy").cast("string")))


def mix(df: DataFrame, weights: dict[str, float] | str, total: int, key: str, domain: str = "domain", seed: int = 42) -> DataFrame:
    """The sampled rows, one per copy. Rows of domains without a weight are not taken."""
    w = resolve_weights(weights)
    names = list(w)
    available = {r[domain]: r["n"] for r in df.where(F.col(domain).isin(names)).groupBy(domain).agg(F.count("*").alias("n")).collect()}  # one row per weighted domain
    return expand(sample(df, quota_table(df.sparkSession, quotas(w, available, total), available), key, domain, seed), key, seed)


def mixing_statistics(df: DataFrame, mixed: DataFrame, weights: dict[str, float], domain: str = "domain") -> DataFrame:
    """(domain, target, input_rows, input_share, output_rows, output_share)."""
    spark = df.sparkSession
    target = spark.createDataFrame([(d, float(w)) for d, w in weights.items()], "domain string, target double")
    a = df.groupBy(F.col(domain).alias("domain")).agg(F.count("*").alias("input_rows"))
    b = mixed.groupBy(F.col(domain).alias("domain")).agg(F.count("*").alias("output_rows"))
    rows = target.join(a, "domain", "full").join(b, "domain", "full").fillna(0)
    every = Window.partitionBy(F.lit(1))  # as many rows as there are domains
    return rows.withColumn("input_share", F.try_divide("input_rows", F.sum("input_rows").over(every))).withColumn("output_share", F.try_divide("output_rows", F.sum("output_rows").over(every)))


def reweight(weights: dict[str, float], losses: dict[str, float], reference: dict[str, float] | None = None, rate: float = 0.01, temperature: float = 0.5, rounds: int = 1) -> dict[str, float]:
    """Exponentiated gradient: weight * exp(rounds * rate * excess / temperature), normalised.

    The excess is the loss above the reference, or above the mean loss without one. Equal rounds with
    constant losses compose, so all are done at once.
    """
    names = list(weights)
    loss = [losses.get(d, 0.0) for d in names]
    base = [reference.get(d, 0.0) for d in names] if reference is not None else [sum(loss) / len(loss)] * len(names)
    raw = [weights[d] * math.exp(rounds * rate * (l - b) / temperature) for d, l, b in zip(names, loss, base)]
    return {d: r / sum(raw) for d, r in zip(names, raw)}


def doremi(df: DataFrame, losses: dict[str, float], reference: dict[str, float] | None, total: int, key: str, domain: str = "domain", rounds: int = 1, composition: str = "doremi", **how) -> DataFrame:
    """Mixture after reweighting from uniform weights; only for the composition `doremi`."""
    if composition != "doremi":
        raise ValueError("reweighting needs the composition doremi")
    return mix(df, reweight(resolve_weights("doremi"), losses, reference, rounds=rounds, **how), total, key, domain)


def load_losses(path: str) -> dict[str, dict[str, float]]:
    """domain_losses, reference_losses and reference_weights of a JSON file; errors are raised."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    return {k: {d: float(x) for d, x in data.get(k, {}).items()} for k in ("domain_losses", "reference_losses", "reference_weights")}


def documents_for_tokens(tokens: int, per_document: int = 500) -> int:
    return tokens // per_document


def source_probabilities(sources: list[dict]) -> list[float]:
    """w / sum(w) of source specifications; a negative weight or a sum of 0 is an error."""
    if any(s["weight"] < 0 for s in sources):
        raise ValueError("weight must not be negative")
    total = sum(s["weight"] for s in sources)
    if not total:
        raise ValueError("weights sum to 0")
    return [s["weight"] / total for s in sources]


def interleave(frames: dict[str, DataFrame], weights: dict[str, float], total: int, key: str, seed: int = 42) -> DataFrame:
    """`total` rows of several sources by weight, in seeded order, with the column `source`."""
    if len(frames) == 1:
        (name, df), = frames.items()
        return df.withColumn("source", F.lit(name)).withColumn("copies", F.lit(1)).withColumn("copy", F.lit(1)).withColumn("place", seeded(key, seed))
    union = None
    for name, df in frames.items():
        part = df.withColumn("source", F.lit(name))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return mix(union, weights, total, key, "source", seed)
