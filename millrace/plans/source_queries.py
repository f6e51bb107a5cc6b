"""Queries of sources, sinks, the pipeline and streams; they write to a temporary folder and read it back."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions.chars import SPACE

from millrace.operators.quality import heuristic_score, pair_counts, train_classifier
from millrace.plans import recipe
from millrace.plans.dedup_queries import SURVIVORS_SQL
from millrace.plans.registry import query
from millrace.session import cut, scratch, table
from millrace.sources import readers, sinks
from millrace.streaming import dedup as streams


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents")
def jsonl_round_trip(spark, d):
    path = scratch(spark, "jsonl") + "/docs.jsonl"
    sinks.write_documents(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), path)
    return readers.read_documents(spark, path).select("id", "text")


@query("SELECT doc_id, text FROM documents")
def parquet_round_trip(spark, d):
    path = scratch(spark, "parquet") + "/docs"
    sinks.write_documents(table(spark, d, "documents").select("doc_id", "text"), path, "parquet")
    return readers.read_first_of(spark, ["no such dataset", path])


@query("SELECT coalesce(CAST(doc_id AS VARCHAR)) AS id, CASE WHEN coalesce(site, '') <> '' THEN site || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents")
def article_fields(spark, d):
    return readers.article_fields(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("site").alias("title"), "text"))


@query("SELECT doc_id FROM documents WHERE length(text) > 500 ORDER BY doc_id LIMIT 100")
def first_kept(spark, d):
    return readers.limit_kept(table(spark, d, "documents").where(F.length("text") > 500), "doc_id", 100).select("doc_id")


@query("SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS INT) AS batch FROM events")
def batch_numbers(spark, d):
    return sinks.batch_numbers(table(spark, d, "events").select("event_id", "user_id"), "event_id", 16, "user_id").select("event_id", "batch")


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 16 AS INT) AS batch FROM events")
def batch_numbers_over_all(spark, d):
    return sinks.batch_numbers(table(spark, d, "events").select("event_id"), "event_id", 16)


# five folders of one file each, of unequal sizes; a document is a line
LINES_SQL = f"SELECT doc_id, regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g') AS text, doc_id % 7 AS part FROM documents"


@query(f"SELECT 'doc_' || (row_number() OVER (ORDER BY least(part, 4), doc_id) - 1) AS id, text, row_number() OVER (ORDER BY least(part, 4), doc_id) - 1 AS ord FROM ({LINES_SQL}) WHERE text <> ''")
def text_lines(spark, d):
    path = scratch(spark, "lines")
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace("text", r"[\r\n]+", " ").alias("value"), F.least(F.col("doc_id") % 7, F.lit(4)).alias("part"))
    docs.repartition(5, "part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    return readers.read_text(spark, path)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE length(text) > 0")
def arrow_files(spark, d):
    """Arrow files as a saved dataset has them, written by tasks and read back through Spark."""
    path = scratch(spark, "arrow")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    for i, b in enumerate(sinks.batches(docs, 5000)):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, b.schema) as w:
            w.write_batch(b)
        sinks.write_bytes(spark, f"{path}/part-{i:05d}.arrow", out.getvalue().to_pybytes())
    return readers.read_arrow_files(spark, path)


@query("SELECT doc_id, coalesce('- ' || text, '') AS sanitised FROM documents")
def text_cache_lookup(spark, d):
    """Sanitised texts of which every second is found in the cache and the others are made."""
    folder = scratch(spark, "cache") + "/table"
    docs = table(spark, d, "documents").select("doc_id", "text")
    make = lambda df: F.concat(F.lit("- "), df["text"])
    sinks.cached(docs.where("doc_id % 2 = 0"), "doc_id", folder, make)
    return sinks.cached(docs, "doc_id", folder, make).select("doc_id", "sanitised")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def appended_metrics(spark, d):
    path = scratch(spark, "metrics")
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    for _ in range(2):
        sinks.append_metrics(rows, path)
    return spark.read.schema("event_type string, n long").json(path)


@query("SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE source IS NOT NULL GROUP BY 1")
def mix_stats_file(spark, d):
    path = scratch(spark, "mix") + ".json"
    rows = table(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
    sinks.write_mix_stats(rows, path, "source")
    whole = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", "map<string,struct<documents:bigint,chars:bigint>>"))
    return whole.select(entries.alias("source", "x")).select("source", "x.documents", "x.chars")


@query("SELECT md5(CAST(doc_id AS VARCHAR)) AS key, coalesce(text, '') AS text FROM documents")
def text_cache(spark, d):
    return sinks.cache_table(table(spark, d, "documents"), "doc_id", "text", scratch(spark, "cache") + "/table").select("key", "text")


@query(None)
def pipeline_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    _, stages = recipe.run(docs, recipe.Recipe(limits={"max_run_repetition": 0.9}, quality=True, allow_fallback=True, snapshots=scratch(spark, "stages")), "doc_id")
    return recipe.stage_counts(stages)


LENGTHS_SQL = "SELECT * FROM (VALUES ('input', 0, (SELECT count(*) FROM documents)), ('deduplicated', 1, (SELECT count(DISTINCT text) FROM documents WHERE length(text) > 0)), ('heuristic', 2, (SELECT count(DISTINCT text) FROM documents WHERE length(text) >= 100 AND length(text) - length(regexp_replace(text, '[\\p{L}\\p{N}]+', '', 'g')) >= 0.7 * length(text) AND length(text) - length(regexp_replace(text, '\\p{L}+', '', 'g')) >= 0.5 * length(text)))) t(stage, place, rows)"


@query(LENGTHS_SQL)
def pipeline_short(spark, d):
    """Exact deduplication and the checks of length and of character classes, the others wide open."""
    wide = {"min_lines": 0, "max_line_chars": 10**9, "max_run_repetition": 1.0, "max_line_repetition": 1.0, "min_word_chars": 0.0, "max_word_chars": 1e9, "balanced": False}
    docs = table(spark, d, "documents").select("doc_id", "text")
    _, stages = recipe.run(docs, recipe.Recipe(clean=False, dedup_method="exact_hash", limits=wide, snapshots=scratch(spark, "stages")), "doc_id")
    return recipe.stage_counts(stages)


@query(None)
def pipeline_models(spark, d):
    """The ensemble of a trained classifier and pair perplexity as the quality stage: rows by stage."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    labelled = docs.where("text IS NOT NULL").select("text", (heuristic_score(F.col("text")) >= 0.8).cast("int").alias("label"))
    models = recipe.Models(train_classifier(labelled, max_rows=20_000), pair_counts(docs))
    _, stages = recipe.run(docs, recipe.Recipe(heuristics=False, quality=True, perplexity=True, max_perplexity=1e6, snapshots=scratch(spark, "stages")), "doc_id", models=models)
    return recipe.stage_counts(stages)


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE length(text) > 0) WHERE r = 1")
def stream_recipe(spark, d):
    """Exact deduplication of a stream with a JSON lines sink that can be started again."""
    out = scratch(spark, "recipe")
    docs = _stream(spark, d, "documents").select("doc_id", "text")
    for _ in range(2):  # started again it finds nothing new
        recipe.run_stream(docs, recipe.Recipe(clean=False, dedup_method="exact_hash", heuristics=False), f"{out}/documents", f"{out}/state", "doc_id").awaitTermination()
    return spark.read.schema("doc_id long, text string").json(f"{out}/documents")


def _stream(spark, d, name: str):
    src = f"{d}/{name}.parquet"
    schema = spark.read.parquet(src).schema
    folder = Path(d)
    glob = f"{name}.parquet" if not (folder / f"{name}.parquet").is_dir() else f"{name}.parquet/*.parquet"
    return spark.readStream.schema(schema).parquet(f"{d}/{glob}" if "*" in glob else d, pathGlobFilter=None if "*" in glob else glob)


def _drain(stream, spark, name: str, mode: str):
    out = scratch(spark, name)
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", out + "/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"SELECT * FROM {name}")


@query("SELECT sha256(text) AS hash FROM documents WHERE length(text) > 0 GROUP BY text")
def stream_exact_dedup(spark, d):
    rows = streams.exact_stream(_stream(spark, d, "documents").select("doc_id", "text"))
    return _drain(rows.select(F.sha2("text", 256).alias("hash")), spark, "stream_exact_dedup", "append")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    w = streams.event_windows(_stream(spark, d, "events"), "ts", "1 day", by="event_type", value="value")
    out = _drain(w.select("event_type", F.col("window.start").alias("day"), "n", "total"), spark, "stream_windows", "complete")
    return out.withColumn("total", F.round("total", 4))


@query(
    """WITH e AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events),
s AS (SELECT event_type, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 5 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT event_type, min(ts) AS begun, count(*) AS n FROM s GROUP BY event_type, k"""
)
def stream_sessions(spark, d):
    s = streams.sessions(_stream(spark, d, "events"), "ts", "event_type", "5 minutes")
    return _drain(s.select("event_type", F.col("session_window.start").alias("begun"), "n"), spark, "stream_sessions", "complete")


@query(SURVIVORS_SQL)
def stream_near_dedup(spark, d):
    return _near(spark, d)


@query(SURVIVORS_SQL)
def stream_filtered_near_dedup(spark, d):
    """The same with Bloom filters of the earlier batches' keys before the stored band rows are read."""
    return _near(spark, d, filter_bits=1 << 20)


def _near(spark, d, **how):
    """A stream of four files, in the order of their documents' ids."""
    out = scratch(spark, "near")
    docs = table(spark, d, "documents").select("doc_id", "text").repartitionByRange(4, "doc_id").withColumn("part", F.spark_partition_id())
    docs = cut(docs)
    for i in range(4):
        docs.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{out}/in")
    sink = streams.NearDedupSink(out + "/kept", "doc_id", "doc_id", slots=8, **how)
    streams.near_stream(streams.read_stream(spark, f"{out}/in", "doc_id long, text string"), sink, f"{out}/c").awaitTermination()
    return sink.kept(spark).select("doc_id")
