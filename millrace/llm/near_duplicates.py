"""Problem 1: records that repeat the text of others with small edits.

Two texts are near-duplicates when the sets of their runs of k characters have a Jaccard similarity
of at least t. The work is done once for each distinct text (tid, see with_text_id), by the comparison
in millrace.functions.similar: tiles of sketches by exclusive-or and bit counts within blocks of equal
minima, tile pairs skipped by the population counts of the shingle sets (their sizes, by which tiles
are ordered: sets whose sizes differ by more than the factor t differ in more places than similar sets
can), and an exact check of what is left. Named, the method compares all tiles of a corpus; that is
quadratic, so blocks of minima come first. A pair at exactly t=0.8 is in no block with probability
2.6e-5. No caps: blocks above `hot` members are split, each two parts a group of their own.

Defined cases: a null text or one shorter than min_chars is in no pair; equal texts are pairs
(similarity 1); tied and repeated rows are kept apart by the key column, and a row without a key is in
no pair; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.groups import components, expand_pairs, pairs_within, text_ids
from millrace.functions.similar import similar_texts
from millrace.session import cut


def _texts(df: DataFrame, key: str, text: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """Texts (id, tid, text) and members (id, tid)."""
    return text_ids(df.where((F.length(text) >= min_chars) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")))


def near_duplicate_pairs(df: DataFrame, key: str = "ord", text: str = "text", min_chars: int = 200, k: int = 13, t: float = 0.8, **how) -> DataFrame:
    """(id_a, id_b): all pairs of rows whose texts are equal or near-duplicates, id_a < id_b."""
    texts, members = _texts(df, key, text, min_chars)
    pairs = similar_texts(texts, k, t, **how).select("a", "b")
    shared = members.groupBy("tid").count().where("count > 1")
    copies = pairs_within(members.join(shared.select("tid").hint("merge"), "tid", "left_semi"), ["tid"], "id")
    rows = expand_pairs(pairs, members).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return rows.unionByName(copies.toDF("id_a", "id_b"))


def _classed(df: DataFrame, key: str, text: str, min_chars: int, k: int, t: float, how: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, tid), classes (tid, text_class) and links (a, b, jaccard) between tids."""
    texts, members = _texts(df, key, text, min_chars)
    links = cut(similar_texts(texts, k, t, **how))
    return members, cut(members.groupBy("tid").agg(F.min("id").alias("text_class"))), links


def near_duplicate_links(df: DataFrame, key: str = "ord", text: str = "text", min_chars: int = 200, k: int = 13, t: float = 0.8, **how) -> DataFrame:
    """One row per row of df: id, text_class (the smallest id with the same text), n_links and group_id.

    n_links counts the different texts that are near-duplicates of this one; group_id is the smallest
    id of the rows connected by links. Rows with a null or short text have neither and no links.
    The links themselves are near_duplicate_classes().
    """
    members, classes, pairs = _classed(df, key, text, min_chars, k, t, how)
    links = pairs.selectExpr("a AS tid").unionAll(pairs.selectExpr("b AS tid")).groupBy("tid").agg(F.count("*").alias("n_links"))
    roots = components(pairs.select("a", "b")).join(classes.withColumnRenamed("tid", "node"), "node")
    groups = roots.join(roots.groupBy("root").agg(F.min("text_class").alias("group_id")), "root").select(F.col("node").alias("tid"), "group_id")
    classes = classes.join(links, "tid", "left").join(groups, "tid", "left")
    found = members.join(classes, "tid").select("id", "text_class", "n_links", F.coalesce("group_id", "text_class").alias("group_id"))
    every = df.select(F.col(key).alias("id")).join(found, "id", "left")
    return every.select("id", "text_class", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "group_id")


def near_duplicate_classes(df: DataFrame, key: str = "ord", text: str = "text", min_chars: int = 200, k: int = 13, t: float = 0.8, **how) -> DataFrame:
    """(class_a, class_b, jaccard), class_a < class_b: every link between different texts, each named by the smallest id that has it."""
    _, classes, pairs = _classed(df, key, text, min_chars, k, t, how)
    named = pairs.join(classes.toDF("a", "x"), "a").join(classes.toDF("b", "y"), "b")
    return named.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), F.round("jaccard", 6).alias("jaccard"))
