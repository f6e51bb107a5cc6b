"""Queries of metrics and arrays over events and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.chars import SPACE
from millrace.operators import arrays as A
from millrace.operators import metrics as M
from millrace.plans.registry import query
from millrace.session import table

E = 8  # experts; an event is a routed token, its user's number chooses the expert, its day is the step
TOKENS = f"(SELECT event_id, user_id, value, CAST(user_id % {E} AS INT) AS expert, CAST(event_id // 100 AS INT) AS step FROM events)"
COUNTS = f"(SELECT s.step, x.expert, CAST(count(t.event_id) AS DOUBLE) AS n FROM (SELECT DISTINCT step FROM {TOKENS}) s CROSS JOIN (SELECT unnest(range({E}))::INT AS expert) x LEFT JOIN {TOKENS} t ON t.step = s.step AND t.expert = x.expert GROUP BY 1, 2)"


def _tokens(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "value", (F.col("user_id") % E).cast("int").alias("expert"), F.floor(F.col("event_id") / 100).cast("int").alias("step"))


def _counts(spark, d):
    per = _tokens(spark, d).groupBy("step").pivot("expert", list(range(E))).count().fillna(0)
    return per.select("step", F.explode(F.array(*[F.struct(F.lit(i).alias("expert"), F.col(str(i)).cast("double").alias("n")) for i in range(E)])).alias("x")).select("step", "x.expert", "x.n")


def rounded(df, *skip, to=6):
    return df.withColumns({c: F.round(c, to) for c, t in df.dtypes if t == "double" and c not in skip})


@query(
    f"""WITH n AS (SELECT x.expert, count(t.event_id) AS n FROM (SELECT unnest(range({E + 2}))::INT AS expert) x LEFT JOIN {TOKENS} t ON t.expert = x.expert GROUP BY 1), p AS (SELECT n, n::DOUBLE / sum(n) OVER () AS p FROM n)
SELECT CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (n > 0) AS used, round(sum(CASE WHEN n > 0 THEN -p * ln(p + 1e-8) END), 6) AS entropy, round(count(*) FILTER (n > 0) / {E + 2}.0::DOUBLE, 6) AS utilisation,
  round(stddev_samp(n) / (avg(n) + 1e-8), 6) AS imbalance, round(min(p), 6) AS min_load, round(max(p), 6) AS max_load FROM p"""
)
def load_metrics(spark, d):
    return rounded(M.load_metrics(_tokens(spark, d), "expert", E + 2))


@query(f"SELECT x.expert, count(t.event_id) AS n, round(count(t.event_id)::DOUBLE / (SELECT count(*) FROM events), 6) AS frequency FROM (SELECT unnest(range({E + 2}))::INT AS expert) x LEFT JOIN {TOKENS} t ON t.expert = x.expert GROUP BY 1")
def expert_frequency(spark, d):
    return rounded(M.expert_frequency(_tokens(spark, d), "expert", E + 2))


@query(
    f"""WITH l AS (SELECT step, expert, n / (sum(n) OVER (PARTITION BY step) + 1e-8) AS load FROM {COUNTS}),
w AS (SELECT step, expert, load, avg(load) OVER w AS mean, stddev_pop(load) OVER w AS std, min(load) OVER w AS min, max(load) OVER w AS max FROM l WINDOW w AS (PARTITION BY expert ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT step, expert, round(load, 6) AS load, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, mean < 0.5 / {E} AS under, mean > 2.0 / {E} AS over FROM w"""
)
def load_window(spark, d):
    return rounded(M.load_window(_counts(spark, d), "step", "expert", "n", E, 20))


@query(
    """SELECT user_id, event_id, round(avg(value) OVER w + 1e-8, 6) AS mean_seconds, round(avg(event_id) OVER w / avg(value) OVER w, 4) AS tokens_per_second, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS tokens_so_far
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"""
)
def step_timing_window(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.col("event_id").alias("tokens"))
    return M.step_timing(e, "user_id", "event_id", "value", "tokens").withColumns({"mean_seconds": F.round(F.col("mean_seconds") + 1e-8, 6), "tokens_per_second": F.round("tokens_per_second", 4)})


@query(
    f"""WITH RECURSIVE l AS MATERIALIZED (SELECT step, expert, n / sum(n) OVER (PARTITION BY step) AS load FROM {COUNTS}),
r AS (SELECT x.expert, CAST(-1 AS INT) AS step, 0.0::DOUBLE AS ema, 0.0::DOUBLE AS bias FROM (SELECT unnest(range({E}))::INT AS expert) x UNION ALL
  SELECT r.expert, r.step + 1, r.ema * 0.9::DOUBLE + load * 0.1::DOUBLE, greatest(-2.0, least(2.0, r.bias - sign(r.ema * 0.9::DOUBLE + load * 0.1::DOUBLE - 1.0 / {E}) * 0.01::DOUBLE)) FROM r JOIN l ON l.expert = r.expert AND l.step = r.step + 1)
SELECT expert, round(arg_max(ema, step), 6) AS ema, round(arg_max(bias, step), 6) AS bias FROM r GROUP BY expert"""
)
def ema_load(spark, d):
    c = _counts(spark, d)
    loads = c.withColumn("load", F.col("n") / F.sum("n").over(Window.partitionBy("step")))
    return rounded(M.ema_load(loads, "expert", "step", "load", E, decay=0.9, gamma=0.01))


@query(
    f"""WITH t AS (SELECT event_id, e.expert, (e.expert = user_id % {E})::INT AS chosen, (1.0 + (event_id * (e.expert + 1)) % 7) / 100.0 AS p FROM events CROSS JOIN (SELECT unnest(range({E})) AS expert) e),
p AS (SELECT expert, sum(chosen)::DOUBLE AS c, avg(p) AS p FROM t GROUP BY 1) SELECT round(sum(c / (SELECT sum(c) FROM p) * p) * {E} * 0.01, 6) AS balance_loss FROM p"""
)
def balance_loss(spark, d):
    e = _tokens(spark, d).select("event_id", "user_id", F.explode(F.sequence(F.lit(0), F.lit(E - 1))).alias("expert"))
    rows = e.select("expert", (F.col("expert") == F.col("user_id") % E).alias("chosen"), ((1.0 + (F.col("event_id") * (F.col("expert") + 1)) % 7) / 100.0).alias("p"))
    return rounded(M.balance_loss(rows, "expert", "p", E, 0.01))


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events WHERE event_type <> 'error' GROUP BY 1")
def metric_means(spark, d):
    return rounded(M.average_metrics(table(spark, d, "events"), "event_type", "value", ("error",)))


PAIR = "(SELECT value AS a, ln(1.0 + event_id % 97) AS b FROM events)"


@query(f"SELECT round(avg((a > b)::INT), 6) AS accuracy, round(avg(a), 6) AS chosen_reward, round(avg(b), 6) AS rejected_reward, round(avg(a - b), 6) AS margin, round(avg(CASE WHEN a - b > 0 THEN ln(1 + exp(b - a)) ELSE b - a + ln(1 + exp(a - b)) END), 6) AS loss FROM {PAIR}")
def pref_accuracy(spark, d):
    rows = table(spark, d, "events").select(F.col("value").alias("a"), F.log(F.lit(1.0) + F.col("event_id") % 97).alias("b"))
    return rounded(M.preference_metrics(rows, "a", "b"))


@query(
    """WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t, count(*) OVER (PARTITION BY user_id) AS n, value AS r, value / 2 AS v FROM events),
d AS (SELECT s.user_id, s.t, s.n, s.r + 0.99::DOUBLE * CASE WHEN s.t = s.n - 1 THEN 0 ELSE x.v END - s.v AS delta FROM s JOIN s x ON x.user_id = s.user_id AND x.t = s.t + 1),
g AS (SELECT a.user_id, a.t, sum(pow(0.99::DOUBLE * 0.95::DOUBLE, b.t - a.t) * b.delta) AS gae FROM d a JOIN d b ON b.user_id = a.user_id AND b.t >= a.t GROUP BY 1, 2)
SELECT user_id, count(*) + 1 AS n, round(max(gae), 4) AS largest, round(min(gae), 4) AS smallest, round(sum(gae), 3) AS total FROM g GROUP BY 1"""
)
def gae_scan(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    rows = s.select("user_id", F.col("s.value").alias("r")).withColumn("v", F.transform("r", lambda x: x / 2))
    g = rows.select("user_id", M.gae(F.col("r"), F.col("v")).alias("g"))
    inner = F.slice("g", F.lit(1), F.size("g") - 1)
    total = F.aggregate("g", F.lit(0.0), lambda a, x: a + x)
    return g.select("user_id", F.size("g").cast("long").alias("n"), F.round(F.array_max(inner), 4).alias("largest"), F.round(F.array_min(inner), 4).alias("smallest"), F.round(total, 3).alias("total"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - embedding[65 - i]::DOUBLE) * (i % 3 > 0)::INT)), 6) AS kl FROM embeddings")
def token_kl(spark, d):
    e = F.col("embedding").cast("array<double>")
    mask = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 3 > 0).cast("int"))
    return rounded(table(spark, d, "embeddings").select("vec_id", M.token_kl(e, F.reverse(e), mask).alias("kl")))


@query("SELECT user_id, round(avg(value), 6) AS loss, round(exp(avg(value) / 100), 6) AS perplexity FROM events GROUP BY 1")
def eval_loss(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("loss"))
    return rounded(e.withColumn("perplexity", F.exp(F.col("loss") / 100)))


@query(
    """WITH e AS (SELECT vec_id, list_transform(range(1, 65), lambda i: {'v': embedding[i]::DOUBLE, 'i': i - 1}) AS l FROM embeddings),
u AS (SELECT vec_id, unnest(l) AS x FROM e), r AS (SELECT vec_id, x.i AS i, row_number() OVER (PARTITION BY vec_id ORDER BY x.v DESC, x.i) AS k FROM u)
SELECT vec_id, list(CAST(i AS INT) ORDER BY k) AS top FROM r WHERE k <= 5 GROUP BY 1"""
)
def topk_filter(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(A.top_k(F.col("embedding"), 5), lambda p: p["index"]).alias("top"))


@query(
    """WITH u AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
g AS (SELECT vec_id, i // 8 AS g, max(v) AS m FROM u GROUP BY 1, 2), b AS (SELECT vec_id, g FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY m DESC, g) AS k FROM g) WHERE k <= 3),
r AS (SELECT u.vec_id, i, row_number() OVER (PARTITION BY u.vec_id ORDER BY v DESC, i) AS k FROM u JOIN b ON b.vec_id = u.vec_id AND b.g = u.i // 8)
SELECT vec_id, list(CAST(i AS INT) ORDER BY k) AS top FROM r WHERE k <= 6 GROUP BY 1"""
)
def grouped_topk(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(A.grouped_top_k(F.col("embedding").cast("array<double>"), 8, 3, 6), lambda p: p["index"]).alias("top"))


@query(
    """WITH u AS (SELECT vec_id, i - 1 AS i, exp(10 * embedding[i]::DOUBLE) AS e FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM u),
c AS (SELECT vec_id, i, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS k FROM p)
SELECT vec_id, list(CAST(i AS INT) ORDER BY k) AS kept FROM c WHERE before <= 0.7 GROUP BY 1"""
)
def nucleus_filter(spark, d):
    return table(spark, d, "embeddings").select("vec_id", A.nucleus(F.transform("embedding", lambda x: x.cast("double") * 10), 0.7).alias("kept"))


@query(
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v, label FROM embeddings),
p AS (SELECT a.label, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) AS c FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT p.label, n.n AS vectors, round(1 - avg(c), 6) AS diversity FROM p JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) n ON n.label = p.label GROUP BY 1, 2"""
)
def cosine_diversity(spark, d):
    return rounded(A.mean_pairwise_cosine(table(spark, d, "embeddings"), "label", "embedding"))


BOOK = np.array([[((i * 31 + j * 17) % 23 - 11) / 60 for j in range(64)] for i in range(16)])
BOOK_SQL = "(SELECT c::INT AS code, list_transform(range(0, 64), lambda j: ((c * 31 + j * 17) % 23 - 11) / 60.0::DOUBLE) AS v FROM (SELECT unnest(range(16)) AS c))"


@query(
    f"""WITH x AS (SELECT vec_id, code, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - v[i]) * (embedding[i]::DOUBLE - v[i]))) AS dist FROM embeddings CROSS JOIN {BOOK_SQL} b)
SELECT vec_id, code FROM (SELECT vec_id, code, row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) AS k FROM x) WHERE k = 1"""
)
def vq_codes(spark, d):
    return A.quantise(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", BOOK).select("vec_id", "code")


@query(
    f"""WITH x AS (SELECT vec_id, code, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - v[i]) * (embedding[i]::DOUBLE - v[i]))) AS dist FROM embeddings CROSS JOIN {BOOK_SQL} b),
b AS (SELECT * FROM (SELECT vec_id, code, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) AS k FROM x) WHERE k = 1) SELECT round(avg(dist / 64), 6) AS mse, round(count(DISTINCT code) / 16.0::DOUBLE, 6) AS used FROM b"""
)
def codebook_usage(spark, d):
    coded = A.quantise(table(spark, d, "embeddings").select("embedding"), "embedding", BOOK)
    return rounded(A.codebook_report(coded, "embedding", "code", BOOK))


@query(None)
def kmeans_codebook(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    centres = A.k_means(rows, "embedding", 8, rounds=10, order="vec_id")
    return rounded(A.codebook_report(A.quantise(rows, "embedding", centres), "embedding", "code", centres))


FRAMES = "(SELECT user_id AS clip, event_id AS frame, [1 + value, 2 + value, 3 + value * 2, 4.0, value] AS mag, [value / 100 - 2, value / 50 - 3, 1.0, -1.0, value / 200] AS ph FROM events)"


@query(
    f"""WITH f AS (SELECT *, lag(ph) OVER (PARTITION BY clip ORDER BY frame) AS b FROM {FRAMES}),
s AS (SELECT clip, frame, list_transform(mag, lambda m: ln(m + 1e-8)) AS l, list_transform(range(1, 6), lambda i: CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE (((ph[i] - b[i] + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) - pi() END) AS p FROM f)
SELECT clip, frame, round((l[1] + l[2]) / 2, 6) AS l0, round((p[1] + p[2]) / 2, 6) AS p0, round((l[3] + l[4] + l[5]) / 3, 6) AS l1, round((p[3] + p[4] + p[5]) / 3, 6) AS p1 FROM s"""
)
def spectral_features(spark, d):
    v = F.col("value")
    f = table(spark, d, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("frame"), F.array(1 + v, 2 + v, 3 + v * 2, F.lit(4.0), v).alias("mag"), F.array(v / 100 - 2, v / 50 - 3, F.lit(1.0), F.lit(-1.0), v / 200).alias("ph"))
    s = A.spectral_features(f, "clip", "frame", "mag", "ph", 2)
    return rounded(s.select("clip", "frame", *[F.col("features")[i].alias(n) for i, n in enumerate(("l0", "p0", "l1", "p1"))]))


@query(
    """WITH f AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value FROM events), p AS (SELECT clip, CAST(i // 4 AS INT) AS pack, list([value, -value] ORDER BY i) AS l FROM f GROUP BY 1, 2)
SELECT clip, pack, list_concat(flatten(l), list_transform(range(0, (8 - 2 * len(l))::BIGINT), lambda x: 0.0::DOUBLE)) AS features FROM p"""
)
def pack_frames(spark, d):
    f = table(spark, d, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("frame"), F.array("value", -F.col("value")).alias("features"))
    return A.pack_frames(f, "clip", "frame", "features", 4)


@query("SELECT user_id AS clip, event_id AS frame, round(exp(value / 100), 6) AS magnitude, round(sum(value / 10) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS phase FROM events")
def reconstruct(spark, d):
    f = table(spark, d, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("frame"), (F.col("value") / 100).alias("l"), (F.col("value") / 10).alias("p"))
    return rounded(A.reconstruct(f, "clip", "frame", "l", "p"))


@query("SELECT event_id, CAST(ceil(ceil(event_id / 160) / 4) AS BIGINT) AS packs, CAST(ceil(ceil(event_id / 160) / 4) AS BIGINT) * 640 AS samples FROM events")
def packed_lengths(spark, d):
    n = A.packed_length(F.col("event_id"), 160, 4)
    return table(spark, d, "events").select("event_id", n.alias("packs"), A.unpacked_length(n, 160, 4).alias("samples"))


@query(
    f"""WITH t AS (SELECT pair_id, chosen AS e, rejected AS g FROM preference WHERE chosen <> '' AND rejected <> ''), w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(e), '{SPACE}+'), lambda x: x <> '')) AS we, list_distinct(list_filter(regexp_split_to_array(lower(g), '{SPACE}+'), lambda x: x <> '')) AS wg FROM t)
SELECT pair_id, round(len(list_filter(range(1, least(length(e), length(g)) + 1), lambda i: substr(e, CAST(i AS BIGINT), 1) = substr(g, CAST(i AS BIGINT), 1))) * 100.0::DOUBLE / greatest(length(e), length(g)), 4) AS by_place,
  round(CASE WHEN len(we) > 0 THEN len(list_intersect(we, wg)) * 100.0::DOUBLE / len(we) ELSE 0 END, 4) AS recall FROM w"""
)
def text_similarity(spark, d):
    rows = table(spark, d, "preference").where("chosen <> '' AND rejected <> ''")
    return rows.select("pair_id", F.round(M.position_similarity(F.col("chosen"), F.col("rejected")), 4).alias("by_place"), F.round(M.word_recall(F.col("chosen"), F.col("rejected")), 4).alias("recall"))


@query(None)
def combined_similarity(spark, d):
    rows = table(spark, d, "preference").where("chosen <> '' AND rejected <> ''")
    return rows.select("pair_id", F.round(M.combined_similarity(F.col("chosen"), F.col("rejected")), 4).alias("score"))


@query("SELECT doc_id, list_filter(['method', 'however', 'river'], lambda p: contains(lower(coalesce(text, '')), p)) AS hits FROM documents")
def pattern_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", M.pattern_hits(F.col("text"), ["method", "however", "river"]).alias("hits"))


@query("SELECT o_orderkey, CASE WHEN r < 19.99 THEN 'under' WHEN r > 26.01 THEN 'over' ELSE 'optimal' END AS band FROM (SELECT o_orderkey, o_totalprice / 10000.0 AS r FROM orders)")
def scaling_band(spark, d):
    return table(spark, d, "orders").select("o_orderkey", M.training_band(F.col("o_totalprice"), F.lit(10000.0)).alias("band"))


@query("SELECT user_id, event_id, round((event_id + 1)::DOUBLE / (1 + event_id % 9), 6) AS ratio, CAST(event_id + 1 - (1 + event_id % 9) AS BIGINT) AS saved, round(avg((event_id + 1)::DOUBLE / (1 + event_id % 9)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) + 1e-8, 6) AS mean_ratio FROM events")
def compression_window(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") + 1).alias("raw"), (1 + F.col("event_id") % 9).alias("packed"))
    return rounded(M.compression(e, "user_id", "event_id", "raw", "packed").withColumn("mean_ratio", F.col("mean_ratio") + 1e-8))


@query("SELECT event_id, value FROM events WHERE user_id >= 10 AND value >= 1 ORDER BY value DESC, event_id LIMIT 3")
def capability_match(spark, d):
    return M.best_matches(table(spark, d, "events"), {"user_id": 10, "value": 1}, "value", "event_id").select("event_id", "value")


@query("SELECT user_id, event_id, row_number() OVER w <= 3 AS keep, row_number() OVER w = 1 AS latest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)")
def retention(spark, d):
    return M.retained(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 3).select("user_id", "event_id", "keep", "latest")


@query("SELECT event_type, arg_min(user_id, n * 1000 + user_id) AS user_id FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def cache_victims(spark, d):
    rows = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("hits"), F.max("event_id").alias("last_used"))
    return M.victims(rows, "event_type", "user_id", "hits", "last_used", 0.0, "lfu")


@query("SELECT event_type, count(*) FILTER (value > 20) AS hits, count(*) FILTER (NOT value > 20) AS misses, round(avg((value > 20)::INT), 6) AS hit_rate FROM events GROUP BY 1")
def cache_hits(spark, d):
    return rounded(M.hit_rate(table(spark, d, "events").withColumn("hit", F.col("value") > 20), "event_type", "hit"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(range(1, 17), lambda i: abs(embedding[i]::DOUBLE) < least(1.0, abs(embedding[i + 16]::DOUBLE) / abs(embedding[i + 32]::DOUBLE))) AS ok FROM embeddings)
SELECT vec_id, CAST(coalesce(list_min(list_filter(range(1, 17), lambda i: NOT ok[i])), 17) - 1 AS INT) AS accepted FROM v"""
)
def draft_acceptance(spark, d):
    part = lambda a: F.transform(F.slice("embedding", a, 16), lambda x: F.abs(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", M.accepted_prefix(part(1), part(17), part(33)).alias("accepted"))


@query(
    """WITH RECURSIVE s AS MATERIALIZED (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, avg((event_id % 5)::DOUBLE / 4) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 1 AS depth FROM events UNION ALL
  SELECT s.user_id, s.k, CASE WHEN m > 0.8 THEN least(depth + 1, 4) WHEN m < 0.5 THEN greatest(depth - 1, 1) ELSE depth END FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1)
SELECT user_id, arg_max(depth, k) AS depth FROM r GROUP BY 1"""
)
def speculation_depth(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 5).alias("accepted"), F.lit(4).alias("proposed"))
    return M.speculation_depth(e, "user_id", "event_id", "accepted", "proposed")


@query("WITH u AS (SELECT vec_id, exp(embedding[i]::DOUBLE) AS e FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)), p AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM u) SELECT vec_id, round(sum(-p * ln(p + 1e-10)), 6) AS entropy FROM p GROUP BY 1")
def prediction_entropy(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", M.entropy(A.softmax(F.col("embedding").cast("array<double>"))).alias("entropy")))


_BALANCE = f"WITH t AS (SELECT event_id, e.expert, (e.expert = user_id % {E})::INT AS chosen, (1.0 + (event_id * (e.expert + 1)) % 7) / 100.0 AS p FROM events CROSS JOIN (SELECT unnest(range({E})) AS expert) e), p AS (SELECT expert, sum(chosen)::DOUBLE / count(*) AS f, avg(p) AS p FROM t GROUP BY 1)"


@query(f"{_BALANCE} SELECT 'tokens' AS form, round(sum(f * p) * {E} * 0.01, 6) AS balance_loss FROM p UNION ALL SELECT 'sequence', round(sum(f * p) * {E} * 0.01 / 2, 6) FROM p")
def balance_loss_forms(spark, d):
    e = _tokens(spark, d).select("event_id", "user_id", F.explode(F.sequence(F.lit(0), F.lit(E - 1))).alias("expert"))
    rows = e.select("expert", (F.col("expert") == F.col("user_id") % E).alias("chosen"), ((1.0 + (F.col("event_id") * (F.col("expert") + 1)) % 7) / 100.0).alias("p"))
    each = [M.balance_loss(rows, "expert", "p", E, 0.01, form, 2).withColumn("form", F.lit(form)) for form in ("tokens", "sequence")]
    return rounded(each[0].unionByName(each[1]))


@query(f"WITH n AS (SELECT step, expert, count(*) AS n FROM {TOKENS} GROUP BY 1, 2) SELECT step, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(greatest(n - 12, 0)) AS BIGINT) AS overflow, round((sum(n) - sum(greatest(n - 12, 0)))::DOUBLE / {12 * E}, 6) AS capacity_used FROM n GROUP BY 1")
def capacity_metrics(spark, d):
    return rounded(M.capacity_metrics(_tokens(spark, d), "step", "expert", E, 12))


@query(
    f"""WITH n AS (SELECT x.expert, count(t.e) AS n FROM (SELECT unnest(range({E})) AS expert) x LEFT JOIN (SELECT unnest([user_id % {E}, (user_id + event_id) % {E}]) AS e FROM events) t ON t.e = x.expert GROUP BY 1)
SELECT round(stddev_samp(n) / (avg(n) + 1e-6), 6) AS balance, round(min(n) / sum(n), 6) AS min_load, round(max(n) / sum(n), 6) AS max_load, (SELECT round(avg(greatest(0.25 + event_id % 4 * 0.125, 0.75 - event_id % 4 * 0.125)), 6) FROM events)::DOUBLE AS router_confidence FROM n"""
)
def expert_balance(spark, d):
    e = table(spark, d, "events")
    w = 0.25 + F.col("event_id") % 4 * 0.125
    rows = e.select(F.array(F.col("user_id") % E, (F.col("user_id") + F.col("event_id")) % E).alias("experts"), F.array(w, 1.0 - w).alias("weights"))
    return rounded(M.expert_balance(rows, "experts", E, "weights"))


@query("WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(sum(value * CASE WHEN i = 1 THEN pow(0.9::DOUBLE, n - 1) ELSE 0.1::DOUBLE * pow(0.9::DOUBLE, n - i) END), 6) AS ema FROM x GROUP BY 1")
def reward_baseline(spark, d):
    return rounded(M.ema(table(spark, d, "events"), "event_type", "event_id", "value", 0.9))


@query(
    """WITH p AS (SELECT q.vec_id AS query, v.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2)))) AS distance FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query, neighbour, round(distance, 5) AS distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS INT) AS rank FROM p) WHERE rank <= 10"""
)
def nearest_vectors(spark, d):
    v = table(spark, d, "embeddings")
    return A.nearest(v.where("vec_id % 20 = 0"), v, 10).withColumn("distance", F.round("distance", 5))
