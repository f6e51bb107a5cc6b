"""Groups of rows without a limit to their size: exact ids of texts, pairs, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

#: Rows of a group that meet in one task at most, and rows of a table that is sent to every task at most.
BLOCK, SENT_ROWS = 2048, 200_000


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """df, marked for sending to every task if its counted rows are few enough for that; df should be cut."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def first_hash(c: Column | str) -> Column:
    return F.xxhash64(c)


def second_hash(c: Column | str) -> Column:
    return F.xxhash64(F.lit("second"), c)


def _identify(rows: DataFrame, clash: DataFrame | None, text: str | None, name: str) -> DataFrame:
    """rows with the id; their hashes are columns _a and _b, or of text."""
    a, b = (F.col("_a"), F.col("_b")) if text is None else (first_hash(text), second_hash(text))
    if clash is None:
        return rows.withColumn(name, a).drop("_a", "_b")
    out = rows.withColumn("_a", a).join(sent(clash), "_a", "left")
    return out.withColumn(name, F.when(F.col("_clash"), F.xxhash64("_a", b)).otherwise(F.col("_a"))).drop("_a", "_b", "_clash")


def _clashes(hashes: DataFrame) -> DataFrame | None:
    found = hashes.groupBy("_a").agg(F.min("_b").alias("lo"), F.max("_b").alias("hi")).where("lo <> hi").select("_a", F.lit(True).alias("_clash"))
    found = cut(found)
    return None if found.isEmpty() else found


def with_text_id(df: DataFrame, text: str = "text", name: str = "tid") -> DataFrame:
    """df with a 64-bit id that is equal for equal texts and different for others.

    The id is the first hash of the text. Texts of 128 bits that share their first 64 are found by one
    aggregation of hashes; their id is made of both hashes instead. At 10^11 texts there are some
    hundreds of them.
    """
    return _identify(df, _clashes(df.select(first_hash(text).alias("_a"), second_hash(text).alias("_b"))), text, name)


def text_ids(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """df with_text_id() as tid, and a written table of its other columns and tid: the texts are read once for both."""
    others = [c for c in df.columns if c != text]
    hashes = cut(df.select(*others, first_hash(text).alias("_a"), second_hash(text).alias("_b")))
    clash = _clashes(hashes)
    return _identify(df, clash, text, "tid"), _identify(hashes, clash, None, "tid")


def pairs_within(members: DataFrame, keys: list[str], member: str, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: every two different members of every group; members should be cut and distinct.

    A group of more than `block` rows is dealt into blocks, and every two of its blocks meet in a task
    of their own.
    """
    rows = members.select(*keys, member)
    size = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    large = cut(size.where(F.col("n") > block).select(*keys, F.ceil(F.col("n") / block).cast("int").alias("g")))
    plain = rows
    if not large.isEmpty():
        few = sent(large)
        plain = rows.join(few, keys, "left_anti")
        dealt = rows.join(few, keys).withColumn("mine", F.pmod(F.xxhash64(member), F.col("g")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        cell = [F.least("mine", "other").alias("_i"), F.greatest("mine", "other").alias("_j")]
        split = dealt.select(*keys, *cell, (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"), member)
        a, b = split.where("left").drop("left", "right"), split.where("right").drop("left", "right")
        on = [*keys, "_i", "_j"]
        crossed = a.withColumnRenamed(member, "a").join(b.withColumnRenamed(member, "b"), on).where("a <> b").select("a", "b", "_i", "_j")
        # inside one block every pair comes twice
        crossed = crossed.where("_i < _j OR a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = plain.withColumnRenamed(member, "a").join(plain.withColumnRenamed(member, "b"), keys).where("a < b").select("a", "b")
    return met if large.isEmpty() else met.unionByName(crossed)


def expand_pairs(pairs: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(x, y): the rows of members (tid, id) for every pair (a, b) of different tids.

    A tid with many rows is dealt into blocks, so that a pair with it is many small joins.
    """
    members = members.select("tid", "id")
    size = members.groupBy("tid").agg(F.count("*").alias("n"))
    large = cut(size.where(F.col("n") > block).select("tid", F.ceil(F.col("n") / block).cast("int").alias("g")))
    if large.isEmpty():
        return pairs.join(members.toDF("a", "x"), "a").join(members.toDF("b", "y"), "b").select("x", "y")
    few = sent(large)
    dealt = members.join(few, "tid", "left").select("tid", "id", F.pmod(F.xxhash64("id"), F.coalesce("g", F.lit(1))).cast("int").alias("part"))

    def dealt_out(rows: DataFrame, side: str) -> DataFrame:
        with_g = rows.join(few.withColumnRenamed("tid", side), side, "left")
        return with_g.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1))).drop("g")

    one = dealt_out(pairs.select("a", "b"), "a").join(dealt.toDF("a", "x", "part"), ["a", "part"]).select("b", "x")
    return dealt_out(one, "b").join(dealt.toDF("b", "y", "part"), ["b", "part"]).select("x", "y")


def pairs_between(few: DataFrame, rows: DataFrame, keys: list[str], member: str, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: every member of few with every other member of rows in the same group, as often as
    both are in one; both cut. Groups are dealt into blocks on both sides."""
    count = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    size = cut(count(few, "f").join(count(rows, "g"), keys).where("f > 1 OR g > 1"))
    left, right = few.select(*keys, F.col(member).alias("a")), rows.select(*keys, F.col(member).alias("b"))
    on = list(keys)
    if not size.isEmpty():
        size = sent(size)
        f, g = F.coalesce("f", F.lit(1)), F.coalesce("g", F.lit(1))
        left = left.join(size, keys, "left").select(*keys, "a", F.pmod(F.xxhash64("a"), f).cast("int").alias("_i"), F.explode(F.sequence(F.lit(0), g - 1)).alias("_j"))
        right = right.join(size, keys, "left").select(*keys, "b", F.pmod(F.xxhash64("b"), g).cast("int").alias("_j"), F.explode(F.sequence(F.lit(0), f - 1)).alias("_i"))
        on += ["_i", "_j"]
    met = left.join(right, on).where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def salted_join(rows: DataFrame, labels: DataFrame, on: str, by: str, how: str = "left", salts: int = 16) -> DataFrame:
    """rows with the labels of their `on`, of which labels has one row each: labels are sent to every
    task if they are few, else repeated so that a hot value of `on` is many keys; by tells its rows apart."""
    if labels.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        return rows.join(F.broadcast(labels), on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return salted.join(labels.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [on, "_salt"], how).drop("_salt")


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes of pairs (a, b): the smallest node each is connected with.

    Every round passes the smallest root among its neighbours to a node, and then the root of that
    root, so chains shorten by halves. Each round is written.
    """
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(most_rounds):
        near = both.join(roots.toDF("b", "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        new = roots.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "m").alias("low"))
        # the root of the root; a node is never its own ancestor, so this only lowers
        jump = new.select(F.col("node").alias("low"), F.col("low").alias("far"))
        new = cut(new.join(jump, "low").select("node", F.col("root").alias("old"), F.least("low", "far").alias("root")))
        changed = not new.where("old <> root").isEmpty()
        roots = new.select("node", "root")
        if not changed:
            return roots
    raise RuntimeError("components did not converge")
