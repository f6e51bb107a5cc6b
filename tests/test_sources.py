import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.plans.recipe import Recipe, process, run, stage_counts
from millrace.sources import readers, sinks
from millrace.streaming import dedup as streams


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  two \nthree\n", encoding="utf-8")
    rows = readers.read_documents(spark, str(tmp_path / "a.txt")).orderBy("ord").collect()
    assert [(r["id"], r["text"]) for r in rows] == [("doc_0", "one"), ("doc_1", "two"), ("doc_2", "three")]


def test_jsonl_with_a_bad_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\nnot json\n', encoding="utf-8")
    rows = readers.read_documents(spark, str(tmp_path / "a.jsonl")).collect()
    assert len(rows) == 2 and sum(r["_corrupt_record"] is not None for r in rows) == 1


def test_path_before_name(tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text("")
    assert readers.resolve(str(p), {str(p): "other"}) == str(p)
    assert readers.resolve("name", {"name": "/there"}) == "/there"
    with pytest.raises(FileNotFoundError):
        readers.resolve("missing")


def test_arrow_files(spark, tmp_path):
    for i in range(2):
        t = pa.table({"title": [f"t{i}", "e"], "text": [f"text {i}", ""]})
        with pa.OSFile(str(tmp_path / f"{i}.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t)
    assert sorted(tuple(r) for r in readers.read_documents(spark, str(tmp_path)).collect()) == [("t0", "text 0"), ("t1", "text 1")]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        readers.read_arrow_files(spark, str(tmp_path / "none"))


def test_mixed_sources(spark, tmp_path):
    for name in "ab":
        spark.createDataFrame([(f"{name}{i}", "x") for i in range(20)], "id string, text string").write.parquet(str(tmp_path / name))
    spec = [{"name": n, "path": str(tmp_path / n), "weight": w} for n, w in (("a", 3.0), ("b", 1.0))]
    rows = readers.read_mixed(spark, spec, 8).collect()
    assert sorted(r["source"] for r in rows) == ["a"] * 6 + ["b"] * 2
    with pytest.raises(ValueError):
        readers.read_mixed(spark, spec, 8, version="v9")


def docs(spark):
    good = ["\n".join(f"Line {i} of text {k} has some words {i * k % 97}" for i in range(30)) for k in (3, 5, 11)]
    return spark.createDataFrame([(str(i), t, "kept") for i, t in enumerate([*good, good[0], "x", None, ""])], "id string, text string, extra string")


def test_pipeline(spark, tmp_path):
    recipe = Recipe(dedup_method="exact", limits={"max_run_repetition": 0.95})
    out, stages = run(docs(spark), recipe)
    assert sorted(r["id"] for r in out.collect()) == ["0", "1", "2"] and "extra" in out.columns
    assert {r["stage"]: r["rows"] for r in stage_counts(stages).collect()} == {"input": 7, "cleaned": 5, "deduplicated": 4, "heuristic": 3}


def test_pipeline_mixing(spark):
    recipe = Recipe(dedup=False, heuristics=False, mixing=True, composition="balanced", target_documents=10)
    out, _ = run(docs(spark), recipe)
    assert out.count() == 10
    with pytest.raises(ValueError):
        recipe.check(streaming=True)


def test_process_writes(spark, tmp_path):
    sinks.write_documents(docs(spark), str(tmp_path / "in.jsonl"))
    stats = process(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), Recipe(dedup_method="exact_hash", heuristics=False))
    assert stats == {"input": 7, "cleaned": 5, "deduplicated": 4}
    assert spark.read.json(str(tmp_path / "out/documents")).count() == 4


def test_recipe_file(tmp_path):
    Recipe(threshold=0.7).save(str(tmp_path / "r.yaml"))
    assert Recipe.load(str(tmp_path / "r.yaml")).threshold == 0.7
    (tmp_path / "bad.yaml").write_text("min_word_count: 3")
    with pytest.raises(ValueError):
        Recipe.load(str(tmp_path / "bad.yaml"))


def test_batches(spark):
    assert [b.num_rows for b in sinks.batches(spark.range(10), 4)] == [4, 4, 2]


def test_near_stream_equals_batch(spark, tmp_path):
    fox = "The quick brown fox jumps over the lazy dog. "
    texts = [fox * 10, "Nothing to do with it at all, whatever comes. " * 6, fox * 12, fox * 10 + "A different sentence. " * 20]
    for i, part in enumerate((texts[:2], texts[2:])):
        spark.createDataFrame([(2 * i + k, t) for k, t in enumerate(part)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    sink = streams.NearDedupSink(str(tmp_path / "kept"), "doc_id", "doc_id")
    stream = streams.read_stream(spark, str(tmp_path / "in/*"), "doc_id long, text string")
    streams.near_stream(stream, sink, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["doc_id"] for r in sink.kept(spark).collect()) == [0, 1, 3]


def test_exact_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = streams.exact_stream(streams.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string")).writeStream.format("memory").queryName("x").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("x").select(F.col("text")).collect() == [("a",)]
