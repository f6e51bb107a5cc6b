"""Queries of near deduplication over documents, first seen by doc_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.arrow import distinct_runs, shingles
from millrace.functions.chars import SPACE
from millrace.functions.groups import sent
from millrace.operators import dedup
from millrace.plans.registry import query
from millrace.session import cut, table

# every run of 13 characters of every text once (a shorter text is one run), and the pairs that share enough
PAIRS_SQL = """
WITH t AS (SELECT doc_id, text FROM documents WHERE length(text) > 0),
g AS (SELECT DISTINCT doc_id, CASE WHEN length(text) <= 13 THEN text ELSE substr(text, i, 13) END AS g
  FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 12, 1) + 1)) AS i FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS lo, b.doc_id AS hi, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT lo, hi, c::DOUBLE / (x.n + y.n - c) AS j FROM c JOIN n x ON x.doc_id = lo JOIN n y ON y.doc_id = hi WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9)
"""
# the greedy choice in order: a row falls if an earlier kept row is similar to it
GREEDY_SQL = PAIRS_SQL.replace("WITH t AS", "WITH RECURSIVE t AS") + """,
node AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS r FROM (SELECT lo AS id FROM pairs UNION SELECT hi FROM pairs)),
near AS MATERIALIZED (SELECT hi, list(lo) AS los FROM pairs GROUP BY hi),
walk AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT node.r, CASE WHEN near.los IS NULL OR NOT list_has_any(walk.kept, near.los) THEN list_append(walk.kept, node.id) ELSE walk.kept END
  FROM walk JOIN node ON node.r = walk.r + 1 LEFT JOIN near ON near.hi = node.id),
kept AS (SELECT unnest(kept) AS id FROM walk WHERE r = (SELECT max(r) FROM walk)),
dropped AS (SELECT hi AS dup_id, min(lo) AS kept_id FROM pairs WHERE lo IN (SELECT id FROM kept) AND hi NOT IN (SELECT id FROM kept) GROUP BY hi)
"""


def _pairs(spark, d, **how):
    return dedup.similar_pairs(table(spark, d, "documents").select("doc_id", "text"), "doc_id", **how)


@query(PAIRS_SQL + "SELECT lo, hi, round(j, 6) AS jaccard FROM pairs")
def near_dup_pairs(spark, d):
    return _pairs(spark, d, method="thorough").select(F.col("lo.key").alias("lo"), F.col("hi.key").alias("hi"), F.round("jaccard", 6).alias("jaccard"))


@query(GREEDY_SQL + "SELECT doc_id FROM t WHERE doc_id NOT IN (SELECT dup_id FROM dropped)")
def near_dup_survivors(spark, d):
    return dedup.near_dedup(table(spark, d, "documents"), "thorough", "doc_id").select("doc_id")


@query(GREEDY_SQL + "SELECT dup_id, kept_id, round(j, 6) AS jaccard FROM dropped JOIN pairs ON lo = kept_id AND hi = dup_id")
def dup_map(spark, d):
    return dedup.duplicate_map(_pairs(spark, d, method="thorough")).withColumn("jaccard", F.round("jaccard", 6))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len(list_distinct(list_transform(range(1, greatest(length(text) - 11, 1)), lambda i: substr(text, CAST(i AS BIGINT), 13)))) END AS runs FROM documents")
def char_ngram_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", distinct_runs("text", 13).alias("runs"))


@query(PAIRS_SQL + "SELECT lo, hi, round(j, 6) AS jaccard FROM pairs")
def lsh_candidates(spark, d):
    """Pairs that share a band of a signature and are similar: the bands lose no pair of these."""
    docs = cut(table(spark, d, "documents").where(F.length("text") > 0).select(F.col("doc_id").alias("key"), F.col("doc_id").alias("ord"), shingles("text", 13).alias("runs")))
    b, r = dedup.finding_bands(0.8)
    pairs = cut(dedup.band_pairs(docs.withColumn("sig", dedup.signature("runs")), "key", "ord", "sig", b, r))
    found = dedup._verify(pairs, docs, "key", "ord", 0.8)
    return found.select(F.col("lo.key").alias("lo"), F.col("hi.key").alias("hi"), F.round("jaccard", 6).alias("jaccard"))


SURVIVORS_SQL = GREEDY_SQL + "SELECT doc_id FROM t WHERE doc_id NOT IN (SELECT dup_id FROM dropped)"


@query(SURVIVORS_SQL)
def minhash_dedup(spark, d):
    return dedup.near_dedup(table(spark, d, "documents"), "minhash", "doc_id").select("doc_id")


@query(SURVIVORS_SQL)
def bloom_dedup(spark, d):
    return dedup.near_dedup(table(spark, d, "documents"), "lshbloom", "doc_id").select("doc_id")


@query(PAIRS_SQL + "SELECT lo, hi, round(j, 6) AS jaccard, true AS near FROM pairs")
def estimated_similarity(spark, d):
    """Exact similarity of the near-duplicate pairs, and whether the estimate of 128 minima is within five deviations of it."""
    pairs = cut(_pairs(spark, d, method="thorough"))
    paired = cut(pairs.select(F.col("lo.key").alias("doc_id")).union(pairs.select("hi.key")).distinct())
    rows = cut(table(spark, d, "documents").join(sent(paired), "doc_id").select("doc_id", dedup.signature(shingles("text", 13)).alias("sig")))
    a = rows.select(F.col("doc_id").alias("lo"), F.col("sig").alias("a"))
    b = rows.select(F.col("doc_id").alias("hi"), F.col("sig").alias("b"))
    pairs = pairs.select(F.col("lo.key").alias("lo"), F.col("hi.key").alias("hi"), "jaccard")
    return pairs.join(a, "lo").join(b, "hi").select("lo", "hi", F.round("jaccard", 6).alias("jaccard"), (F.abs(dedup.estimated_jaccard("a", "b") - F.col("jaccard")) <= 5 * F.sqrt(0.25 / F.lit(128))).alias("near"))


@query("SELECT band::INT AS band, 2097152 AS bits, 15 AS hashes, 262144 AS bytes FROM (SELECT unnest(range(20)) AS band) WHERE EXISTS (SELECT 1 FROM documents WHERE length(text) > 0)")
def band_filters(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") > 0).select(dedup.bloom_signature("text").alias("sig"))
    return dedup.band_sketch(docs, "sig", 20, 6).select("band", "bits", "hashes", F.octet_length("filter").alias("bytes"))


# runs of five words of the first row of every text
_WORDS = f"list_filter(regexp_split_to_array(lower(text), '{SPACE}+'), lambda x: x <> '')"
_TEXTS = "SELECT doc_id, text FROM documents WHERE length(text) > 0"
ARTICLES_SQL = GREEDY_SQL.replace(_TEXTS, f"SELECT min(doc_id) AS doc_id, text FROM documents WHERE length(text) > 0 GROUP BY text").replace(
    PAIRS_SQL[PAIRS_SQL.index("g AS (SELECT DISTINCT") : PAIRS_SQL.index("n AS (SELECT doc_id, count")],
    f"""w AS (SELECT doc_id, {_WORDS} AS w FROM t),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w)),
""",
)


@query(ARTICLES_SQL + f"SELECT dup_id AS doc_id FROM dropped UNION ALL SELECT doc_id FROM ({_TEXTS}) WHERE doc_id NOT IN (SELECT doc_id FROM t)")
def article_duplicates(spark, d):
    return dedup.article_duplicates(table(spark, d, "documents"), "doc_id", "doc_id")
