"""Problem 8: spans of at least `span` characters that stand verbatim in more than one record.

Prefix-partitioned sparse suffix trees. Not every suffix is kept: with k = span//2 + 1 and
w = span - k + 1, the anchors of a text are the places whose run of k characters has the smallest
hash in some window of w places. Any run of `span` characters holds one whole window, so two texts
that share it have the same anchor in it; about 2/(w+1) of all suffixes are left.

1. One pass gives a row for each anchor: (run hash, text id, place, hash of what comes before). The
   rows are shuffled and sorted by the run hash, that is the suffixes are split by a prefix of k
   characters. Only groups of several texts go on, and for pairs only those in which suffixes differ
   in what comes before (left-maximal): where the previous anchor and its distance are the same, the
   shared span begins earlier and is found there.
2. For them the text is joined once and cut to w-1 characters before and `span` after the anchor.
3. The suffixes of a prefix group are sorted; the common prefixes of neighbours give the internal
   nodes of their tree, each with its depth (right-maximal repeats). Under a node of depth D the
   leaves that also agree in the span-D characters before the anchor share a span: a deep node.
   A prefix group of more than `hot` suffixes fits no task; it is split by longer prefixes of variable
   length, span-l characters from the anchor together with the l before it, for each l < w, so that a
   group is one deep node and needs no tree. Equal sets of texts are reduced to one before any pair is
   formed, and the pairs of a large set are formed in blocks.

How much of a text is shared is found without pairs: the longest match of a suffix is with a
neighbour of another text in the sorted order, to the left as to the right.

The result is exact but for collisions of 64-bit hashes of runs of k characters within a group, which
only make it larger, and of 128-bit hashes in groups above `hot`.

Defined cases: null, empty and shorter texts share nothing; equal texts of the length are pairs; a
passage repeated only within one record is none; a row without a key is in no pair; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.groups import expand_pairs, pairs_within, sent, text_ids
from millrace.functions.rolling import code_points, mix, rolling, sliding
from millrace.functions.runs import column, whole_runs
from millrace.session import cut

HOT = 4096


def anchors(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of k characters that are smallest in some window of w runs."""
    v = rolling(code_points(text), k)
    if len(v) < w:
        return np.empty(0, np.int64), v[:0]
    low = sliding(v, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([pad, low, pad]), w, np.maximum) == v)
    return at, v[at]


def _anchor_rows(k: int, w: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            tids, texts = b.column("tid").to_pylist(), b.column("text")
            out: list[tuple] = []
            for i, tid in enumerate(tids):
                if tid in seen:
                    continue
                seen.add(tid)
                at, h = anchors(texts[i].as_py(), k, w)
                before = np.empty(len(h), np.uint64)
                before[1:] = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + np.diff(at).astype(np.uint64))
                before[:1] = np.array([tid], np.int64).view(np.uint64)  # the beginning of a text is like no other
                out.append((h.view(np.int64), np.full(len(h), tid, np.int64), at.astype(np.int32), before.view(np.int64)))
            if len(seen) > 200_000:  # copies met later are dropped after the shuffle
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([np.concatenate(c) for c in zip(*out)], names=["h", "tid", "place", "before"])

    return rows


def _several(hot: int, left_maximal: bool):
    """Of rows sorted by h, tid, place: those whose h has several texts, with left_maximal only where what comes before differs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, is_hot in whole_runs(batches, "h", hot, ["tid", "place"]):
            h, tid, before = (column(table, c) for c in ("h", "tid", "before"))
            if is_hot:
                keep = np.ones(len(h), bool)
            else:
                starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
                size = np.diff(np.append(starts, len(h)))
                several = [np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts) for c in ((tid, before) if left_maximal else (tid,))]
                keep = np.repeat(np.logical_and.reduce(several), size)
            t = table.filter(pa.array(keep)).select(["h", "tid", "place"]).append_column("hot", pa.array(np.full(int(keep.sum()), is_hot)))
            yield from t.to_batches()

    return rows


def _contexts(span: int, w: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, tid, place, hot, left, around = [], [], [], [], [], []
            for i in range(b.num_rows):
                text, one = b.column("text")[i].as_py(), b.column("tid")[i].as_py()
                for a in b.column("anchors")[i].as_py():
                    p = a["place"]
                    h.append(a["h"]), tid.append(one), place.append(p), hot.append(a["hot"])
                    left.append(min(w - 1, p)), around.append(text[max(0, p - w + 1) : p + span])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(tid, pa.int64()), pa.array(place, pa.int32()), pa.array(hot, pa.bool_()), pa.array(left, pa.int32()), pa.array(around, pa.string())],
                names=["h", "tid", "place", "hot", "left", "around"],
            )

    return rows


def neighbours(texts: list[str], width: int) -> np.ndarray:
    """Length of the common beginning of each text with the one before it, at most width; 0 for the first."""
    size = np.array([min(len(t), width) for t in texts])
    points = code_points("".join(t[:width].ljust(width, "\0") for t in texts)).reshape(len(texts), width)
    differ = points[1:] != points[:-1]
    upto = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.concatenate([[0], np.minimum(upto, np.minimum(size[1:], size[:-1]))])


def tree_nodes(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, stop) of the internal nodes of at least that depth, from the common beginnings of sorted neighbours."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(common) + 1):
        c = common[i] if i < len(common) else 0
        first = i - 1
        while stack and stack[-1][0] > c:
            depth, first = stack.pop()
            yield depth, first, i
        if c >= least and (not stack or stack[-1][0] < c):
            stack.append((c, first))


def deep_nodes(around: list[str], left: list[int], span: int) -> Iterator[tuple[int, list[int]]]:
    """(depth, leaves) of one prefix group: suffixes, by index, that agree in depth characters from the
    anchor on and in the span - depth before it."""
    order = sorted(range(len(around)), key=lambda i: around[i][left[i] :])
    common = neighbours([around[i][left[i] :] for i in order], span)
    for depth, first, stop in tree_nodes(common.tolist(), max(1, span - max(left))):
        need = span - depth
        leaves: dict[str, list[int]] = {}
        for i in order[first:stop]:
            if left[i] >= need:
                leaves.setdefault(around[i][left[i] - need : left[i]], []).append(i)
        for same in leaves.values():
            if len(same) > 1:
                yield depth, same


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[str], list[int]]]:
    """(tid, place, around, left) of each prefix group of several texts."""
    for table, _ in whole_runs(batches, "h", 1 << 31):
        h = column(table, "h")
        tid, place, left, around = (table.column(c).to_pylist() for c in ("tid", "place", "left", "around"))
        edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]]).tolist()
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                yield tid[a:b], place[a:b], around[a:b], left[a:b]


def _sets(span: int):
    """(id, members) of the different sets of texts below the deep nodes; id is 128 bits of the members' hash."""
    import xxhash

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.list_(pa.int64()))], names=["id", "members"])

        held = 0
        for tid, _, around, left in _groups(batches):
            for _, leaves in deep_nodes(around, left, span):
                members = sorted({tid[i] for i in leaves})
                if len(members) > 1:
                    one = xxhash.xxh3_128_digest(np.array(members, np.int64).tobytes())
                    if one not in seen:
                        seen[one] = members
                        held += len(members)
                        if held > 500_000:
                            yield flush()
                            seen.clear()
                            held = 0
        if seen:
            yield flush()

    return rows


def furthest(words: list[str], tid: list[int], width: int) -> list[int]:
    """For each of sorted words the longest common beginning with one of another tid."""
    common = neighbours(words, width).tolist()
    n = len(words)
    best = [0] * n
    for order in (range(1, n), range(n - 2, -1, -1)):
        step = 1 if order.step > 0 else -1
        now = [0] * n
        for i in order:
            j = i - step
            c = common[i] if step > 0 else common[j]
            now[i] = c if tid[i] != tid[j] else min(c, now[j])
            best[i] = max(best[i], now[i])
    return best


def _extents(span: int, w: int):
    """(tid, start, end): for each suffix the stretch around it that lies in spans shared with another text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tid, place, around, left in _groups(batches):
            start, end = [1 << 30] * len(tid), [0] * len(tid)
            for depth, leaves in deep_nodes(around, left, span):
                if len({tid[i] for i in leaves}) < 2:
                    continue
                back = sorted((around[i][: left[i]][::-1], i) for i in leaves)
                at = [i for _, i in back]
                for i, n in zip(at, furthest([b for b, _ in back], [tid[i] for i in at], w - 1) if w > 1 else [0] * len(at)):
                    if n >= span - depth:
                        start[i], end[i] = min(start[i], place[i] - n), max(end[i], place[i] + depth)
            keep = [i for i in range(len(tid)) if end[i]]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], t) for c, t in ((tid, pa.int64()), (start, pa.int32()), (end, pa.int32()))], names=["tid", "start", "end"])

    return rows


def _suffixes(texts: DataFrame, span: int, hot: int, left_maximal: bool) -> tuple[DataFrame, DataFrame]:
    """Suffixes (h, tid, place, left, around) of prefix groups of several texts: the groups that fit a task, and the others."""
    k = span // 2 + 1
    w = span - k + 1
    if k < w:
        raise ValueError("span is too short")
    rows = texts.mapInArrow(_anchor_rows(k, w), "h long, tid long, place int, before long")
    several = rows.repartition("h").sortWithinPartitions("h", "tid", "place").mapInArrow(_several(hot, left_maximal), "h long, tid long, place int, hot boolean")
    by_text = several.groupBy("tid").agg(F.collect_list(F.struct("h", "place", "hot")).alias("anchors"))
    one = texts.select("tid", "text").dropDuplicates(["tid"])
    around = cut(by_text.join(one, "tid").mapInArrow(_contexts(span, w), "h long, tid long, place int, hot boolean, left int, around string"))
    fit = around.where("NOT hot").drop("hot").repartition("h").sortWithinPartitions("h", "tid", "place")
    return fit, around.where("hot").drop("hot")


def _windows(large: DataFrame, span: int) -> DataFrame:
    """(win, tid, place, l): the suffixes of large groups by each longer prefix, span - l characters and the l before."""
    each = large.select("tid", "place", F.explode(F.sequence(F.lit(0), F.col("left"))).alias("l"), "left", "around")
    each = each.select("tid", "place", "l", F.expr(f"substring(around, left - l + 1, {span})").alias("win")).where(F.length("win") == span)
    return each.withColumn("win", F.unhex(F.md5("win")))


def sharing_texts(texts: DataFrame, span: int = 200, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: pairs of distinct texts (tid, text) with a shared span."""
    fit, large = _suffixes(texts, span, hot, left_maximal=True)
    sets = cut(fit.mapInArrow(_sets(span), "id binary, members array<long>").dropDuplicates(["id"]))
    pairs = sets.where(F.size("members") == 2).select(F.col("members")[0].alias("a"), F.col("members")[1].alias("b"))
    more = sets.where(F.size("members") > 2)
    if not more.isEmpty():
        pairs = pairs.unionByName(pairs_within(cut(more.select("id", F.explode("members").alias("tid"))), ["id"], "tid"))
    if not large.isEmpty():
        # windows of one shared span hold the same texts: of equal sets one window is kept
        window = cut(_windows(large, span).select("win", "tid").distinct())
        bits = [F.bit_xor(F.xxhash64(F.lit(i), "tid")) for i in (1, 2)]
        kept = window.groupBy("win").agg(F.count("*").alias("n"), bits[0].alias("x"), bits[1].alias("y")).where("n > 1")
        kept = cut(kept.groupBy("n", "x", "y").agg(F.min("win").alias("win")).select("win"))
        pairs = pairs.unionByName(pairs_within(cut(window.join(sent(kept), "win", "left_semi")), ["win"], "tid"))
    return pairs.distinct()


def shared_stretches(texts: DataFrame, span: int = 200, hot: int = HOT) -> DataFrame:
    """(tid, start, end): stretches of distinct texts (tid, text) that together are all that lies in spans shared with another text."""
    fit, large = _suffixes(texts, span, hot, left_maximal=False)
    out = fit.mapInArrow(_extents(span, span - span // 2), "tid long, start int, end int")
    if not large.isEmpty():
        # a suffix whose whole surroundings stand in another text is done; two texts of each such group stay for the others
        large = large.withColumn("c", F.unhex(F.md5("around")))
        same = cut(large.groupBy("c", "left").agg(F.min("tid").alias("low"), F.max("tid").alias("high")).where("low <> high"))
        known = large.join(sent(same), ["c", "left"], "left")
        begin = F.col("place") - F.col("left")
        out = out.unionByName(known.where("low IS NOT NULL").select("tid", begin.alias("start"), (begin + F.length("around")).alias("end")).where(F.col("end") - F.col("start") >= span))
        window = cut(_windows(known.where("low IS NULL OR tid = low OR tid = high"), span))
        several = cut(window.groupBy("win").agg(F.min("tid").alias("low"), F.max("tid").alias("high")).where("low <> high").select("win"))
        first = F.col("place") - F.col("l")
        shared = window.join(sent(several), "win", "left_semi")
        out = out.unionByName(shared.groupBy("tid", "place").agg(F.min(first).alias("start"), F.max(first + span).alias("end")).select("tid", "start", "end"))
    return out


def _texts(df: DataFrame, key: str, text: str, span: int) -> tuple[DataFrame, DataFrame]:
    """Texts (id, tid, text) and members (id, tid)."""
    return text_ids(df.where((F.length(text) >= span) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")))


def sharing_records(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200, **how) -> DataFrame:
    """(id_a, id_b): pairs of rows whose texts have span consecutive characters in common, id_a < id_b."""
    texts, members = _texts(df, key, text, span)
    pairs = sharing_texts(texts.select("tid", "text"), span, **how)
    shared = members.groupBy("tid").count().where("count > 1")
    copies = pairs_within(members.join(shared.select("tid").hint("merge"), "tid", "left_semi"), ["tid"], "id")
    rows = expand_pairs(pairs, members).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return rows.unionByName(copies.toDF("id_a", "id_b"))


def shared_extent(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200, **how) -> DataFrame:
    """(key, chars, shared_chars, share): how much of each row's text lies in spans of at least `span`
    characters that also stand in another row. A row with an equal text elsewhere is shared whole.
    """
    texts, members = _texts(df, key, text, span)
    stretches = shared_stretches(texts.select("tid", "text"), span, **how)
    # union of the stretches of a text, in order of their starts
    ordered = F.array_sort(F.collect_list(F.struct("start", "end")))
    begin = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("sum"))
    step = lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["start"]))).alias("sum"))
    covered = stretches.groupBy("tid").agg(F.aggregate(ordered, begin, step, lambda s: s["sum"]).alias("covered"))
    classes = members.groupBy("tid").agg(F.count("*").alias("rows")).join(covered, "tid", "left")
    found = members.join(classes, "tid").select("id", (F.col("rows") > 1).alias("whole"), "covered")
    every = df.select(F.col(key).alias("id"), F.length(text).alias("chars")).join(found, "id", "left")
    shared = F.when(F.col("whole"), F.col("chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return every.select(F.col("id").alias(key), "chars", shared.alias("shared_chars"), F.round(F.try_divide(shared.cast("double"), F.col("chars")), 6).alias("share"))
