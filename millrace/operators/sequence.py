"""Token sequences: native tokens, padding, labels, multi-token targets, masks, modalities.

A null text has no tokens. Arrays of a row belong together by position; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.chars import let, words
from millrace.functions.groups import sent
from millrace.session import cut

IGNORED = -100

#: Half-open ranges of token ids by modality, and the ranges allowed in an audio mode.
MODALITIES = (("text", 100_000), ("audio", 110_000), ("special", 111_000), ("phoneme", 116_000), ("reserved", 128_000))
AUDIO_MODES = {"mulaw": (50_000, 50_256), "spec": (50_262, 51_286)}


def word_ids(c: Column, vocabulary: int = 50_000) -> Column:
    """Ids of the words between blanks by hash: the same in every engine, no vocabulary needed."""
    return F.transform(words(F.coalesce(c, F.lit(""))), lambda w: F.pmod(F.conv(F.left(F.md5(w), F.lit(7)), 16, 10).cast("int"), F.lit(vocabulary)))


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """The first `length` ids, filled up with pad."""
    kept = F.slice(ids, F.lit(1), F.lit(length))
    return F.concat(kept, F.array_repeat(F.lit(pad), F.lit(length) - F.size(kept)))


def attention_mask(ids: Column, length: int) -> Column:
    kept = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(length) - kept))


def clamp_ids(ids: Column, vocabulary: int) -> Column:
    return F.transform(ids, lambda i: F.least(i, F.lit(vocabulary - 1)))


def lm_labels(ids: Column, mask: Column, masked: bool = True) -> Column:
    """Copy of ids, IGNORED where the mask is 0; masked=False keeps the padding as one of the loaders does."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 0, F.lit(IGNORED)).otherwise(i)) if masked else ids


def mtp_labels(ids: Column, mask: Column, depth: int = 2, compat: bool = False) -> Column:
    """For each place the next `depth` ids, IGNORED where place or target is masked or out of range.

    compat checks only the place itself for the first target, as the described loaders do, so the
    last real place gets the first padding id.
    """

    def targets(i: Column) -> Column:
        out = []
        for d in range(1, depth + 1):
            there = F.coalesce(F.try_element_at(mask, i + d), F.lit(0)) != 0
            inside = i + d <= F.size(ids)
            ok = (F.element_at(mask, i) != 0) & inside & (F.lit(True) if compat and d == 1 else there)
            out.append(F.when(ok, F.try_element_at(ids, i + d)).otherwise(F.lit(IGNORED)))
        return F.array(*out)

    return F.when(F.size(ids) == 0, F.array().cast("array<array<int>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))), targets))


def count_tokens(df: DataFrame, mask: str) -> DataFrame:
    one = F.aggregate(F.col(mask), F.lit(0).cast("long"), lambda a, m: a + m)
    return df.agg(F.sum(one).alias("tokens"), F.count("*").alias("rows"))


def prompt_masked_labels(ids: Column, template: Column) -> Column:
    """IGNORED up to the first place after the first one where the template begins; all IGNORED without it."""
    n, k = F.size(ids), F.size(template)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > 1) & (i + k - 1 <= n) & (F.slice(ids, i, k) == template))
    first = F.coalesce(F.try_element_at(starts, F.lit(1)), n + 1)
    return let(first, lambda at: F.transform(ids, lambda x, j: F.when(j + 1 < at, F.lit(IGNORED)).otherwise(x)))


def modality(token: Column) -> Column:
    out = F.when(token.isNull(), None)
    for name, end in MODALITIES:
        out = out.when(token < end, name)
    return out.otherwise("unknown")


def allowed(token: Column, ranges: list[tuple[int, int]], special: list[int] = ()) -> Column:
    ok = token.isin(*special) if special else F.lit(False)
    for a, b in ranges:
        ok = ok | ((token >= a) & (token < b))
    return ok


def mask_values(values: Column, ranges: list[tuple[int, int]], special: list[int] = (), masked: float = float("-inf"), first_id: int = 0) -> Column:
    """values (one for each token id from first_id on), `masked` where the id is not allowed."""
    return F.transform(values, lambda v, i: F.when(allowed(i + first_id, ranges, special), v).otherwise(F.lit(masked)))


def mode_ranges(mode: str) -> list[tuple[int, int]]:
    if mode not in AUDIO_MODES:
        raise ValueError(f"unknown audio mode {mode}")
    return [AUDIO_MODES[mode]]


def with_place(df: DataFrame, order: str) -> DataFrame:
    """df with `_place`, the number of rows before it in order, and `_all`, the number of rows.

    Places come from the counts of range partitions, a row for each, not from one window over all rows.
    """
    ranged = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min(order).alias("_min"))
    before = Window.orderBy("_min").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all")))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    rows = ranged.withColumn("_rank", rank).join(sent(counts), "_part")
    return rows.withColumn("_place", F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")


def contiguous_shards(df: DataFrame, order: str, shards: int) -> DataFrame:
    """df with `shard`: n div shards rows each in order, the remainder in the last."""
    each = F.greatest(F.floor(F.col("_all") / shards), F.lit(1))
    rows = with_place(df, order)
    return rows.withColumn("shard", F.least(F.floor(F.col("_place") / each), F.lit(shards - 1)).cast("int")).drop("_place", "_all")
