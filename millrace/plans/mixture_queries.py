"""Queries of domain mixtures over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import domains, mixture
from millrace.plans.registry import query
from millrace.plans.text_queries import DOMAIN_SQL
from millrace.session import cut, table

WEIGHTS = mixture.PRESETS["default"]
TOTAL = 1500
LOSSES = {"common_crawl": 2.5, "wikipedia": 2.0, "code": 4.1, "academic": 2.8, "books": 2.6, "news": 2.4, "social": 2.2}
REFERENCE = {"common_crawl": 2.3, "wikipedia": 2.1, "code": 2.1, "academic": 2.7, "books": 2.7, "news": 2.4, "social": 2.3}


def _rows(spark, d):
    """(doc_id, domain), written once: the sampling reads it several times."""
    rows = domains.classify(table(spark, d, "documents").select("doc_id", "text"), method="keyword")
    return cut(rows.select("doc_id", F.col("domain_found").alias("domain")))


def _mixed(spark, d):
    return mixture.mix(_rows(spark, d), WEIGHTS, TOTAL, "doc_id")


def _values(m: dict) -> str:
    return ", ".join(f"('{k}', {i}, CAST({v!r} AS DOUBLE))" for i, (k, v) in enumerate(m.items()))


# largest remainder, then what belongs to domains without rows
QUOTA_SQL = f"""
WITH w AS (SELECT * FROM (VALUES {_values(WEIGHTS)}) AS v(domain, place, w)),
a AS (SELECT domain, count(*) AS available FROM {DOMAIN_SQL} GROUP BY 1),
e AS (SELECT w.domain, place, {TOTAL} * w / (SELECT sum(w) FROM w) AS x, coalesce(available, 0) AS available FROM w LEFT JOIN a ON w.domain = a.domain),
f AS (SELECT *, floor(x) + (row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, place) <= {TOTAL} - sum(floor(x)) OVER ())::INT AS q FROM e),
l AS (SELECT coalesce(sum(q) FILTER (available = 0), 0) AS loose, sum(q) FILTER (available > 0) AS base FROM f),
g AS (SELECT f.*, floor(loose * (q / base)) AS more, row_number() OVER (ORDER BY (available > 0) DESC, q DESC, place) AS top, loose FROM f CROSS JOIN l),
h AS (SELECT domain, available, CASE WHEN available = 0 THEN 0 ELSE q + more + CASE WHEN top = 1 THEN loose - (SELECT sum(more) FROM g WHERE available > 0) ELSE 0 END END AS quota FROM g)
"""
SAMPLE_SQL = QUOTA_SQL + f""",
r AS (SELECT doc_id, h.domain, CAST(quota AS BIGINT) AS quota, available, row_number() OVER (PARTITION BY h.domain ORDER BY md5('42|' || doc_id), doc_id) AS rank FROM {DOMAIN_SQL} d JOIN h ON h.domain = d.domain),
s AS (SELECT doc_id, domain, quota // available + (rank <= quota % available)::INT AS copies FROM r)
"""


@query(QUOTA_SQL + "SELECT domain, CAST(quota AS BIGINT) AS quota, available FROM h")
def mix_quota(spark, d):
    rows = _rows(spark, d)
    available = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # one row per domain
    return mixture.quota_table(spark, mixture.quotas(mixture.resolve_weights("default"), available, TOTAL), available)


@query(SAMPLE_SQL + ", k AS (SELECT doc_id, domain, unnest(range(1, copies + 1)) AS copy FROM s WHERE copies > 0) SELECT doc_id, domain, CAST(copy AS INT) AS copy, md5('42|' || doc_id || '|' || copy) AS place FROM k")
def mix_sample(spark, d):
    return _mixed(spark, d).select("doc_id", "domain", "copy", "place")


@query(
    SAMPLE_SQL
    + """, o AS (SELECT domain, sum(copies) AS n FROM s GROUP BY 1), i AS (SELECT domain, count(*) AS n FROM """
    + DOMAIN_SQL
    + """ GROUP BY 1)
SELECT w.domain, w.w AS target, CAST(coalesce(i.n, 0) AS BIGINT) AS input_rows, CAST(coalesce(o.n, 0) AS BIGINT) AS output_rows,
  round(coalesce(i.n, 0) / (SELECT sum(n) FROM i), 6) AS input_share, round(coalesce(o.n, 0) / (SELECT sum(n) FROM o), 6) AS output_share
FROM w LEFT JOIN i ON w.domain = i.domain LEFT JOIN o ON w.domain = o.domain"""
)
def mix_stats(spark, d):
    out = mixture.mixing_statistics(_rows(spark, d), _mixed(spark, d), WEIGHTS)
    return out.withColumns({c: F.round(c, 6) for c in ("input_share", "output_share")})


@query(
    f"WITH l AS (SELECT * FROM (VALUES {_values(LOSSES)}) AS v(domain, place, loss)), r AS (SELECT * FROM (VALUES {_values(REFERENCE)}) AS v(domain, place, reference)), "
    "e AS (SELECT domain, exp(3 * 0.01 * (loss - reference) / 0.5) / 7 AS x FROM l JOIN r USING (domain)) SELECT domain, round(x / sum(x) OVER (), 9) AS weight FROM e"
)
def doremi_weights(spark, d):
    w = mixture.reweight(mixture.resolve_weights("doremi"), LOSSES, REFERENCE, rounds=3)
    return spark.createDataFrame([(k, round(v, 9)) for k, v in w.items()], "domain string, weight double")


@query(None)
def doremi_mix(spark, d):
    return mixture.doremi(_rows(spark, d), LOSSES, REFERENCE, 1000, "doc_id", rounds=3).select("doc_id", "domain", "copy")


@query("SELECT mix, name, weight, round(weight / sum(weight) OVER (PARTITION BY mix), 9) AS share FROM dolma_sources WHERE weight IS NOT NULL")
def source_weights(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "dolma_sources").where("weight IS NOT NULL")
    return rows.select("mix", "name", "weight", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("mix")), 9).alias("share"))


@query(
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS rank FROM documents WHERE lang IN ('en', 'fr')),
m AS (SELECT least(count(*) FILTER (lang = 'en') // 3, count(*) FILTER (lang = 'fr')) AS m FROM r)
SELECT doc_id, lang AS source FROM r, m WHERE rank <= CASE lang WHEN 'en' THEN 3 * m ELSE m END"""
)
def interleave(spark, d):
    """Three to one, as many rows as both sources have in that ratio."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    frames = {k: docs.where(F.col("lang") == k) for k in ("en", "fr")}
    n = {k: f.count() for k, f in frames.items()}
    return mixture.interleave(frames, {"en": 3.0, "fr": 1.0}, 4 * min(n["en"] // 3, n["fr"]), "doc_id").select("doc_id", "source")


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id)")
def shuffle_order(spark, d):
    from millrace.sources.readers import seeded_order

    return seeded_order(table(spark, d, "documents").select("doc_id"), "doc_id")
