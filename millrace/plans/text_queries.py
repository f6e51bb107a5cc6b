"""Queries of cleaning, filters, quality and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tables
from millrace.functions.chars import ALNUM, ALPHA, NOT_SPACE, SPACE, UPPER, WORD, count, words
from millrace.operators import cleaning, dedup, domains, filters, quality
from millrace.plans.registry import query
from millrace.session import table


def q(s: str) -> str:
    """A pattern inside an SQL string."""
    return s.replace("'", "''")


CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"
SQL_CLEAN = f"trim(regexp_replace(regexp_replace(text, '{CONTROLS}', '', 'g'), '{SPACE}+', ' ', 'g'), ' ')"


def n_of(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{q(pattern)}'))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"SELECT doc_id, {SQL_CLEAN} AS cleaned FROM documents")
def clean_ws(spark, d):
    return _docs(spark, d).select("doc_id", cleaning.collapse_blanks(cleaning.drop_controls("text")).alias("cleaned"))


@query(
    f"WITH c AS (SELECT text, {SQL_CLEAN} AS t FROM documents) SELECT count(text) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars_before, CAST(sum(length(t)) AS BIGINT) AS chars_after, "
    "CAST(sum(greatest(length(text) - length(t), 0)) AS BIGINT) AS chars_removed, round(sum(greatest(length(text) - length(t), 0)) / sum(length(text)), 6) AS removed_share FROM c"
)
def clean_stats(spark, d):
    rows = _docs(spark, d).withColumn("t", cleaning.collapse_blanks(cleaning.drop_controls("text")))
    return cleaning.cleaning_stats(rows, "text", "t").withColumn("removed_share", F.round("removed_share", 6))


@query(None)
def clean_full(spark, d):
    return _docs(spark, d).select("doc_id", cleaning.clean("text").alias("cleaned"))


@query("SELECT doc_id, regexp_replace(text, '<[^>]+>', '', 'g') AS plain FROM documents")
def strip_markup(spark, d):
    return _docs(spark, d).select("doc_id", cleaning.strip_markup("text").alias("plain"))


@query(
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)" + q("|".join(cleaning.BOILERPLATE)) + "', '', 'g'), '(?is)==\\s*References\\s*==.*', '', 'g'), "
    "'(?is)==\\s*Bibliography\\s*==.*', '', 'g'), '(?is)==\\s*Sources\\s*==.*', '', 'g') AS plain FROM documents"
)
def boilerplate(spark, d):
    return _docs(spark, d).select("doc_id", cleaning.strip_boilerplate("text").alias("plain"))


FIRST = "SELECT min(doc_id) AS doc_id, text FROM documents WHERE length(text) > 0 GROUP BY text"


@query(f"SELECT doc_id, sha256(text) AS hash FROM ({FIRST})")
def exact_dedup(spark, d):
    return dedup.exact_dedup(_docs(spark, d), "text", "doc_id").select("doc_id", F.sha2("text", 256).alias("hash"))


@query(
    f"SELECT count(*) AS total, count(*) FILTER (coalesce(length(text), 0) = 0) AS empty, (SELECT count(*) FROM ({FIRST})) AS kept, count(*) - count(*) FILTER (coalesce(length(text), 0) = 0) - (SELECT count(*) FROM ({FIRST})) AS duplicates, "
    f"round((count(*) - count(*) FILTER (coalesce(length(text), 0) = 0) - (SELECT count(*) FROM ({FIRST}))) / count(*), 6) AS duplicate_share FROM documents"
)
def dedup_stats(spark, d):
    docs = _docs(spark, d)
    return dedup.dedup_stats(docs, dedup.exact_dedup(docs, "text", "doc_id")).withColumn("duplicate_share", F.round("duplicate_share", 6))


LINES = f"list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '')"
PAIRS = "regexp_replace({}, '\\(\\)|\\[\\]|\\{{\\}}', '', 'g')"
FEATURES = f"""
WITH RECURSIVE b AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[^()\\[\\]{{}}]', '', 'g') AS m FROM documents),
r AS (SELECT doc_id, m, 0 AS i FROM b UNION ALL
  SELECT doc_id, {PAIRS.format("m")}, i + 1 FROM r WHERE {PAIRS.format("m")} <> m),
nest AS (SELECT doc_id, arg_max(m, i) = '' AS nested FROM r GROUP BY doc_id),
f AS (SELECT b.doc_id, t, length(t) AS chars, len(string_split(t, chr(10))) AS lines,
  list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) AS longest_line,
  CASE WHEN length(t) > 2 THEN 1.0::DOUBLE - len(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, CAST(i AS BIGINT), 3))))::DOUBLE / (length(t) - 2) ELSE 0.0::DOUBLE END AS run_repetition,
  CASE WHEN len({LINES}) > 0 THEN 1.0::DOUBLE - len(list_distinct({LINES}))::DOUBLE / len({LINES}) ELSE 0.0::DOUBLE END AS line_repetition,
  CASE WHEN length(t) > 0 THEN 1.0::DOUBLE - {n_of("t", ALNUM)}::DOUBLE / length(t) ELSE 1.0::DOUBLE END AS special,
  CASE WHEN length(t) > 0 THEN {n_of("t", ALPHA)}::DOUBLE / length(t) ELSE 0.0::DOUBLE END AS alpha,
  {n_of("t", WORD + "+")} AS words,
  CASE WHEN {n_of("t", WORD + "+")} > 0 THEN {n_of("t", WORD)}::DOUBLE / {n_of("t", WORD + "+")} ELSE 0.0::DOUBLE END AS word_chars,
  nested AND (length(t) - length(replace(t, '"', ''))) % 2 = 0 AS balanced
  FROM b JOIN nest USING (doc_id))"""
REASON = """CASE WHEN chars NOT BETWEEN 100 AND 1000000 THEN 'doc_length' WHEN lines < 3 OR longest_line > 10000 THEN 'line_filters'
  WHEN run_repetition > {rep} OR line_repetition > 0.3 THEN 'repetition' WHEN special > 0.3 OR alpha < 0.5 THEN 'special_chars'
  WHEN words = 0 OR word_chars NOT BETWEEN 2 AND 20 THEN 'word_stats' WHEN NOT balanced THEN 'unbalanced' ELSE 'pass' END"""


@query(FEATURES + f" SELECT {REASON.format(rep='0.2')} AS reason, count(*) AS n FROM f GROUP BY 1")
def heuristic_reasons(spark, d):
    return filters.reason_counts(filters.heuristic_filter(_docs(spark, d)))


@query(FEATURES + f" SELECT doc_id, {REASON.format(rep='0.9')} AS reason FROM f")
def heuristic_reason_rows(spark, d):
    rows = filters.heuristic_filter(_docs(spark, d), limits=filters.HeuristicLimits(max_run_repetition=0.9))
    return rows.select("doc_id", F.coalesce("reject_reason", F.lit("pass")).alias("reason"))


@query(FEATURES + " SELECT doc_id, lines, longest_line, round(line_repetition, 6) AS line_repetition FROM f")
def line_stats(spark, d):
    return filters.heuristic_features(_docs(spark, d)).select("doc_id", "features.lines", "features.longest_line", F.round("features.line_repetition", 6).alias("line_repetition"))


@query(FEATURES + " SELECT doc_id, round(special, 6) AS special, round(alpha, 6) AS alpha FROM f")
def char_class_ratios(spark, d):
    return filters.heuristic_features(_docs(spark, d)).select("doc_id", F.round("features.special", 6).alias("special"), F.round("features.alpha", 6).alias("alpha"))


@query(FEATURES + " SELECT doc_id, words, round(word_chars, 6) AS word_chars FROM f")
def word_stats(spark, d):
    return filters.heuristic_features(_docs(spark, d)).select("doc_id", "features.words", F.round("features.word_chars", 6).alias("word_chars"))


@query(FEATURES + " SELECT doc_id, balanced FROM f")
def bracket_balance(spark, d):
    return filters.heuristic_features(_docs(spark, d)).select("doc_id", "features.balanced")


@query(FEATURES + " SELECT doc_id, round(run_repetition, 6) AS run_repetition FROM f")
def trigram_repetition(spark, d):
    return filters.heuristic_features(_docs(spark, d)).select("doc_id", F.round("features.run_repetition", 6).alias("run_repetition"))


W = f"list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '')"
STOPS = ", ".join(f"'{w}'" for w in filters.ExtraLimits().stop_words)


@query(
    f"""SELECT doc_id, CASE WHEN length(t) < 200 THEN 'chars' WHEN len({W}) NOT BETWEEN 50 AND 100000 THEN 'words'
  WHEN {n_of("t", NOT_SPACE)}::DOUBLE / len({W}) NOT BETWEEN 3 AND 10 THEN 'word_chars'
  WHEN {n_of("t", chr(92) + "p{Nd}")}::DOUBLE / length(t) > 0.3 THEN 'digits' WHEN {n_of("t", UPPER)}::DOUBLE / length(t) > 0.3 THEN 'upper'
  WHEN {n_of("t", "[.][.][.]|…")} / (len({W}) / 100.0::DOUBLE) > 30 THEN 'ellipses'
  WHEN {n_of("t", "(?m)^[" + chr(92) + "t ]*[-*•‣]")} / (len({W}) / 100.0::DOUBLE) > 20 THEN 'bullets'
  WHEN len(list_filter(list_transform({W}, lambda x: lower(x)), lambda x: x IN ({STOPS})))::DOUBLE / len({W}) < 0.1 THEN 'stop_words' ELSE 'pass' END AS reason
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
)
def extra_reasons(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce(filters.extra_reason(F.col("text")), F.lit("pass")).alias("reason"))


SCORE = f"""CASE WHEN length(t) = 0 THEN 0.0::DOUBLE ELSE (CASE WHEN length(t) < 100 THEN 0.5::DOUBLE WHEN length(t) < 200 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN len({W}) < 50 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN len({W}) > 0 AND len(list_distinct({W}))::DOUBLE / len({W}) < 0.3 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN {n_of("t", ALPHA)}::DOUBLE / length(t) < 0.5 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN {n_of("t", ALPHA)} > 0 AND {n_of("t", UPPER)}::DOUBLE / {n_of("t", ALPHA)} > 0.3 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END) END"""
SCORED = f"(SELECT doc_id, {SCORE} AS score FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"


@query(f"SELECT doc_id, round(score, 6) AS score FROM {SCORED}")
def quality_score(spark, d):
    return _docs(spark, d).select("doc_id", F.round(quality.heuristic_score(F.col("text")), 6).alias("score"))


@query(f"SELECT doc_id, round(score * 0.6 + (1.0 - (length(coalesce(text, '')) % 1000) / 1000.0) * 0.4, 6) AS score FROM {SCORED} JOIN documents USING (doc_id)")
def quality_ensemble(spark, d):
    p = quality.perplexity_score(F.length(F.coalesce("text", F.lit(""))) % 1000)
    return _docs(spark, d).select("doc_id", F.round(quality.ensemble(quality.heuristic_score(F.col("text")), p), 6).alias("score"))


@query(
    f"""WITH w AS (SELECT doc_id, list_concat([''], list_filter(regexp_split_to_array(lower(text), '{SPACE}+'), lambda x: x <> '')) AS w FROM documents WHERE text IS NOT NULL),
  p AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
  c AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2), f AS (SELECT a, sum(n) AS n FROM c GROUP BY 1),
  v AS (SELECT count(DISTINCT b) + 1 AS v FROM c),
  s AS (SELECT doc_id, avg(log10((c.n + 1)::DOUBLE / (f.n + v.v))) AS m FROM p JOIN c USING (a, b) JOIN f USING (a) CROSS JOIN v GROUP BY doc_id)
  SELECT d.doc_id, round(coalesce(pow(10.0, -m), 500.0), 3) AS perplexity FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id"""
)
def pair_perplexity(spark, d):
    docs = _docs(spark, d)
    return quality.perplexity(docs, quality.pair_counts(docs), "doc_id").withColumn("perplexity", F.round("perplexity", 3))


@query(None)
def quality_classifier(spark, d):
    """Trained on at most 2,000 rows chosen by hash; label: the heuristic score of at least 0.7. Scores every row."""
    docs = _docs(spark, d).select("doc_id", "text", (quality.heuristic_score(F.col("text")) >= 0.7).cast("double").alias("label"))
    return quality.classifier_score(docs, quality.train_classifier(docs, features=1 << 13, max_rows=2000)).select("doc_id", "label", "score")


HITS = {name: " + ".join(f"regexp_matches(h, '(?i){q(p)}')::INT" for p in patterns) for name, patterns in domains.PATTERNS.items()}
DOMAIN_SQL = f"""(SELECT doc_id, text, CASE WHEN greatest({", ".join(HITS)}) = 0 THEN 'common_crawl' {" ".join(f"WHEN {k} = greatest({', '.join(HITS)}) THEN '{k}'" for k in HITS)} END AS domain,
  CASE WHEN greatest({", ".join(HITS)}) = 0 THEN 0.5::DOUBLE ELSE least(greatest({", ".join(HITS)}) / 3.0::DOUBLE, 1.0::DOUBLE) END AS confidence
  FROM (SELECT doc_id, text, {", ".join(f"{v} AS {k}" for k, v in HITS.items())} FROM (SELECT doc_id, text, coalesce(text, '') AS h FROM documents)))"""


@query(f"SELECT doc_id, domain, round(confidence, 6) AS confidence FROM {DOMAIN_SQL}")
def domain_keyword(spark, d):
    return domains.classify(_docs(spark, d), method="keyword").select("doc_id", F.col("domain_found").alias("domain"), F.round("domain_confidence", 6).alias("confidence"))


@query("SELECT doc_id, coalesce(domain, 'common_crawl') AS domain, CASE WHEN domain IS NULL THEN 0.3 ELSE 1.0 END::DOUBLE AS confidence FROM documents")
def domain_metadata(spark, d):
    return domains.classify(_docs(spark, d), label="domain", method="metadata").select("doc_id", F.col("domain_found").alias("domain"), F.col("domain_confidence").alias("confidence"))


@query(f"SELECT domain, count(*) AS documents, CAST(sum(length(coalesce(text, '')) // 4) AS BIGINT) AS tokens FROM {DOMAIN_SQL} GROUP BY domain")
def domain_counts(spark, d):
    return domains.domain_counts(domains.classify(_docs(spark, d), method="keyword"))


CLEANED = f"trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '{SPACE}+', ' ', 'g'), ' ')"
SENT = f"list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '')"
SENT_WORDS = f"list_sum(list_transform({SENT}, lambda x: len(list_filter(regexp_split_to_array(x, '{SPACE}+'), lambda y: y <> ''))))::DOUBLE / len({SENT})"
OTHER = "[^a-zA-Z0-9\\t-\\r\\x1c-\\x1f \\x{85}\\p{Z}.!?,;:'\"-]"
LOW_WORDS = f"list_filter(regexp_split_to_array(lower(t), '{SPACE}+'), lambda x: x <> '')"
LETTERS = f"regexp_extract_all(lower(t), '{ALPHA}')"


def _top(items: str) -> str:
    return f"coalesce(list_max(map_values(list_histogram({items})))::DOUBLE / nullif(len({items}), 0), 0.0::DOUBLE)"


def _top_share(items: str) -> str:
    return f"coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT unnest({items}) AS x) GROUP BY x))::DOUBLE / nullif(len({items}), 0), 0.0::DOUBLE)"


@query(
    f"""WITH c AS (SELECT doc_id, coalesce(text, '') AS raw, coalesce({CLEANED}, '') AS t FROM documents),
  letters AS (SELECT doc_id, max(n)::DOUBLE / sum(n) AS s FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest({LETTERS}) AS x FROM c) GROUP BY 1, 2) GROUP BY 1),
  ws AS (SELECT doc_id, max(n)::DOUBLE / sum(n) AS s FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest({LOW_WORDS}) AS x FROM c) GROUP BY 1, 2) GROUP BY 1),
  f AS (SELECT c.doc_id, t, len(list_filter(regexp_split_to_array(raw, '{SPACE}+'), lambda x: x <> '')) AS raw_n, len({W}) AS n, coalesce(letters.s, 0) AS ls, coalesce(ws.s, 0) AS wss,
    CASE WHEN len({W}) > 0 THEN {n_of("t", NOT_SPACE)}::DOUBLE / len({W}) ELSE 0 END AS mean,
    (CASE WHEN len({SENT}) > 0 AND ({SENT_WORDS} < 5 OR {SENT_WORDS} > 50) THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END)
    * (CASE WHEN len({W}) > 0 AND ({n_of("t", "[.!?,;:]")}::DOUBLE / len({W}) < 0.05 OR {n_of("t", "[.!?,;:]")}::DOUBLE / len({W}) > 0.3) THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END)
    * (CASE WHEN length(t) > 0 AND ({n_of("t", UPPER)}::DOUBLE / length(t) < 0.01 OR {n_of("t", UPPER)}::DOUBLE / length(t) > 0.1) THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END)
    * (CASE WHEN length(t) > 0 AND {n_of("t", OTHER)}::DOUBLE / length(t) > 0.1 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END) AS quality
    FROM c LEFT JOIN letters ON c.doc_id = letters.doc_id LEFT JOIN ws ON c.doc_id = ws.doc_id)
  SELECT doc_id, CASE WHEN raw_n < 50 OR raw_n > 15000 THEN 'invalid_length' WHEN length(t) < 50 THEN 'empty_after_cleaning' WHEN n NOT BETWEEN 50 AND 10000 OR mean NOT BETWEEN 3 AND 10 THEN 'invalid_length'
    WHEN quality < 0.7 THEN 'low_quality' WHEN ls > 0.2 OR wss > 0.2 THEN 'too_repetitive' ELSE 'pass' END AS reason FROM f"""
)
def sanitize_reasons(spark, d):
    rows = _docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("raw")).withColumn("t", cleaning.collapse_blanks(cleaning.strip_markup("raw")))
    return filters.article_reason(rows, "raw", "t").select("doc_id", F.coalesce("reject_reason", F.lit("pass")).alias("reason"))


@query(f"SELECT doc_id, round(max(n)::DOUBLE / sum(n), 6) AS share FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{SPACE}+'), lambda x: x <> '')) AS x FROM documents) GROUP BY 1, 2) GROUP BY 1")
def word_share(spark, d):
    rows = _docs(spark, d).select("doc_id", words(F.lower("text")).alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", F.round(filters.top_share(F.col("w")), 6).alias("share"))


@query(None)
def language_id(spark, d):
    from millrace.operators import language

    docs = _docs(spark, d)
    model = language.train(docs)
    return docs.select("doc_id", "lang", language.identify("text", model).alias("found")).select("doc_id", "lang", F.col("found.lang").alias("found"), F.round("found.confidence", 6).alias("confidence"))


@query(None)
def sanitize_reasons_full(spark, d):
    """The whole article cascade: markup, boilerplate, language, quality, repetition, duplicates."""
    from millrace.operators import language

    docs = _docs(spark, d).select("doc_id", "lang", "text")
    rows = docs.withColumn("raw", F.coalesce("text", F.lit(""))).withColumn("t", cleaning.clean_article("raw"))
    twice = dedup.article_duplicates(rows, "doc_id", "doc_id", "t").withColumn("twice", F.lit(True))
    rows = rows.join(twice, "doc_id", "left").withColumn("english", language.in_language("t", language.train(docs)))
    out = filters.article_reason(rows, "raw", "t", F.col("english"), F.coalesce("twice", F.lit(False)))
    return out.select("doc_id", F.coalesce("reject_reason", F.lit("pass")).alias("reason"))


@query("SELECT doc_id, count(DISTINCT run) AS runs FROM (SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, i, 40) END AS run FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 39, 1) + 1)) AS i FROM documents WHERE length(text) > 0)) GROUP BY 1")
def lateral_runs(spark, d):
    """A table function in SQL; operators use the vectorised functions instead."""
    tables.register(spark)
    _docs(spark, d).where("length(text) > 0").select("doc_id", "text").createOrReplaceTempView("texts_with_runs")
    return spark.sql("SELECT doc_id, count(run) AS runs FROM texts_with_runs, LATERAL text_runs(text, 40) GROUP BY doc_id")
