"""Signatures, neighbours, limits from settings, quality stage and its guard, restarted streams, caches, shared folders."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import similar, tokenizer
from millrace.operators import arrays, conversation, dedup, filters, metrics
from millrace.operators.quality import pair_counts, train_classifier
from millrace.plans import recipe
from millrace.sources import readers, sinks
from millrace.streaming import dedup as streams

RNG = random.Random(11)


def noise(n, alphabet="abcdefghijklmnop qrstuvwxyz."):
    return "".join(RNG.choice(alphabet) for _ in range(n))


def test_shifted_minima():
    h = np.array([RNG.randrange(1 << 32) for _ in range(50)], np.uint64)
    want = [min((int(x) + i * 0x9E3779B9) % (1 << 32) for x in h) for i in range(120)]
    assert dedup._shifted_minima(h, 120).tolist() == want


def test_bloom_signature_compat_is_of_digests(spark):
    import hashlib

    t = noise(60)
    h = [int.from_bytes(hashlib.sha256(t[i : i + 13].encode()).digest()[-4:]) for i in range(48)]
    (r,) = spark.createDataFrame([(t,)], "text string").select(dedup.bloom_signature("text", compat=True).alias("s")).collect()
    assert r["s"] == [min((x + i * 0x9E3779B9) % (1 << 32) for x in h) for i in range(120)]


def test_byte_signatures(spark):
    def fnv(run):
        h = 2166136261
        for b in run:
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h % dedup.MERSENNE

    raw = "héllo wörld".encode()
    assert dedup.byte_run_hashes(raw, 5).tolist() == sorted({fnv(raw[i : i + 5]) for i in range(len(raw) - 4)})
    assert dedup.byte_run_hashes(b"ab", 5).tolist() == [fnv(b"ab")] and not len(dedup.byte_run_hashes(b"", 5))
    a = noise(3000)
    b = a[:2700] + noise(300)
    rows = spark.createDataFrame([(a, b, None)], "a string, b string, c string")
    (r,) = rows.select(dedup.estimated_jaccard(dedup.byte_signature("a"), dedup.byte_signature("b")).alias("e"), dedup.byte_signature("c").alias("n")).collect()
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b)]
    assert abs(r["e"] - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.2 and r["n"] is None


@pytest.mark.parametrize("hot", [4096, 3])
def test_similar_runs(spark, hot):
    base = [[RNG.randrange(1 << 40) for _ in range(40)] for _ in range(4)]
    rows = [(i, b[: 40 - k] + [RNG.randrange(1 << 40) for _ in range(k)]) for i, (b, k) in enumerate((b, k) for b in base for k in (0, 1, 3, 9, 20))] + [(90, []), (91, [5])]
    df = spark.createDataFrame(rows, "tid long, runs array<long>")
    got = {(r["a"], r["b"]) for r in similar.similar_runs(df, 0.8, hot=hot).collect()}
    sets = {i: set(r) for i, r in rows if r}
    assert got == {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def test_nearest(spark):
    g = np.random.default_rng(2)
    v = g.normal(size=(60, 4))
    v[7] = v[8]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in arrays.nearest(rows.where("vec_id % 5 = 2"), rows, 3, block=16).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["neighbour"]
    for q, found in got.items():
        d = sorted((float(np.linalg.norm(v[q] - v[j])), j) for j in range(60) if j != q)
        assert [found[i] for i in (1, 2, 3)] == [j for _, j in d[:3]]
    assert len(got) == 12 and arrays.nearest(rows.limit(0), rows, 3).count() == 0


def test_article_limits(tmp_path):
    nested = {"_comment": "x", "language_filtering": {"target_language": "de", "_citation": "y"}, "length_constraints": {"min_article_length": 9}, "deduplication": {"enabled": True}}
    (tmp_path / "s.json").write_text(json.dumps(nested))
    limits, rest = filters.load_article_limits(str(tmp_path / "s.json"))
    assert (limits.language, limits.min_words, limits.max_words) == ("de", 9, 10_000) and rest == {"deduplication.enabled": True}
    assert filters.article_limits({"min_quality_score": 0.5, "max_words": 7})[0] == filters.ArticleLimits(min_quality=0.5, max_words=7)
    with pytest.raises(ValueError):
        filters.article_limits({"min_words": 1, "length": {"min_article_length": 2}})


def test_unsafe_content_is_a_hook(spark):
    text = ("A rather plain sentence of some words stands here today. " * 12).strip()
    rows = spark.createDataFrame([(1, text), (2, text + " Forbidden words.")], "id long, t string")
    out = filters.article_reason(rows, "t", "t", limits=filters.ArticleLimits(max_char_repetition=1, max_word_repetition=1, min_quality=0), safe=~F.col("t").contains("Forbidden"))
    assert {r["id"]: r["reject_reason"] for r in out.collect()} == {1: None, 2: "unsafe_content"}


def prose(spark):
    rows = [(i, f"Here is a text number {i} that tells of things and of people in the town. " * 8) for i in range(6)] + [(9, "zq " * 200)]
    return spark.createDataFrame(rows, "id long, text string")


def test_quality_needs_a_model(spark):
    r = recipe.Recipe(clean=False, dedup=False, heuristics=False, quality=True)
    with pytest.raises(ValueError):
        recipe.run(prose(spark), r)
    with pytest.raises(ValueError):
        recipe.Recipe(quality=True, classifier=False).check()
    r.allow_fallback = True
    assert {x["id"] for x in recipe.run(prose(spark), r)[0].collect()} >= {0, 5}


def test_quality_by_models(spark):
    df = prose(spark)
    labelled = df.withColumn("label", (F.col("id") < 9).cast("int"))
    models = recipe.Models(train_classifier(labelled, features=1 << 10), pair_counts(df.where("id < 9")))
    for how in ({}, {"perplexity": True, "max_perplexity": 20.0}, {"classifier": False, "perplexity": True, "max_perplexity": 20.0}):
        r = recipe.Recipe(clean=False, dedup=False, heuristics=False, quality=True, **how)
        out = recipe.run(df, r, models=models)[0]
        assert out.columns == ["id", "text"] and {x["id"] for x in out.collect()} == set(range(6))


def test_a_stream_goes_on_and_repeats_nothing(spark, tmp_path):
    body = [noise(400) for _ in range(6)]
    batches = [[(0, body[0]), (1, body[1]), (2, body[0])], [(3, body[1][:-3] + "zzz"), (4, body[2]), (5, None)], [(6, body[2]), (7, body[3])]]
    for bits in (0, 1 << 14):
        where = tmp_path / str(bits)
        sink = streams.NearDedupSink(str(where / "kept"), "doc_id", "doc_id", slots=4, filter_bits=bits, jsonl=str(where / "out"))
        for i, rows in enumerate(batches):
            df = spark.createDataFrame(rows, "doc_id long, text string")
            sink(df, i)
            sink(df, i)  # a batch that is run again
        assert sorted(r["doc_id"] for r in sink.kept(spark).collect()) == [0, 1, 4, 7]
        assert sorted(r["doc_id"] for r in spark.read.json(str(where / "out/*")).collect()) == [0, 1, 4, 7]


def test_streamed_recipe(spark, tmp_path):
    docs = [(str(i), f"Line one of {i}.\nLine two of {i}.\n" + noise(300)) for i in range(4)]
    for i, part in enumerate((docs[:2], [docs[1], *docs[2:], ("x", "tiny")])):
        spark.createDataFrame(part, "id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.read_stream(spark, str(tmp_path / "in"), "id string, text string")
        for method, out in (("exact_hash", "a"), ("minhash", "b")):
            r = recipe.Recipe(clean=False, dedup_method=method, limits={"max_run_repetition": 1.0, "max_special": 1.0})
            recipe.run_stream(stream, r, str(tmp_path / out), str(tmp_path / f"state{out}")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "a")).collect()) == ["0", "1", "2", "3"]
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "b/*")).collect()) == ["0", "1", "2", "3"]
    with pytest.raises(ValueError):
        recipe.run(stream, recipe.Recipe())


def test_jsonl_stream(spark, tmp_path):
    spark.createDataFrame([("1", "short"), ("2", None)], "id string, text string").write.parquet(str(tmp_path / "in"))
    streams.jsonl_stream(streams.read_stream(spark, str(tmp_path / "in"), "id string, text string"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.schema("id string").json(str(tmp_path / "out")).count() == 0


def test_cache_makes_only_what_is_missing(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def make(df):
        @F.udf("string")
        def up(t):
            made.add(1)
            return t.upper()

        return up("text")

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id long, text string")
    folder = str(tmp_path / "cache")
    sinks.cached(rows.where("id < 4"), "id", folder, make).collect()
    assert made.value == 4
    got = sinks.cached(rows, "id", folder, make)
    assert {r["id"]: r["sanitised"] for r in got.collect()} == {i: f"T{i}" for i in range(6)} and made.value == 6


def test_text_files_in_order_of_paths(spark, tmp_path):
    sizes = {c: RNG.randint(1, 40) for c in "abcdefghijklmnopqrst"}
    for c, n in sizes.items():
        (tmp_path / f"{c}.txt").write_text("\n".join(f"{c}{i}" for i in range(n)) + "\n\n")
    rows = readers.read_text(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["text"] for r in rows] == [f"{c}{i}" for c, n in sizes.items() for i in range(n)] and [r["ord"] for r in rows] == list(range(len(rows)))


def test_encoded_pairs(spark):
    ids = tokenizer.bpe_ids(spark)
    rows = spark.createDataFrame([("What is it? " * 5, "It is.", None)], "prompt string, chosen string, rejected string")
    (r,) = conversation.encode_pairs(rows, ids, 16).collect()
    enc = tokenizer.encoding(open(tokenizer.RANKS, "rb").read())
    assert r["prompt_ids"] == enc.encode_ordinary("What is it? " * 5)[:8] and len(r["chosen_ids"]) == len(r["chosen_mask"]) == 16
    assert r["rejected_ids"] == enc.encode_ordinary("What is it? " * 5 + "\n\n")[:16]


def test_capacity(spark):
    rows = spark.createDataFrame([(0, e) for e in (0, 0, 0, 1)], "step int, expert int")
    assert metrics.capacity_metrics(rows, "step", "expert", 4, 2).collect() == [(0, 4, 1, 3 / 8)]


def test_folders_are_shared(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://there:7077"

    with pytest.raises(ValueError):
        session.shared_folder(Fake())
