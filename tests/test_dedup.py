"""Deduplication: golden cases and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.arrow import shingles
from millrace.operators import dedup

FOX = "The quick brown fox jumps over the lazy dog. "


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def kept(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def grams(t, n=13):
    return {t[i : i + n] for i in range(len(t) - n + 1)} if len(t) > n else ({t} if t else set())


def greedy(texts, t=0.8):
    out = []
    for i, x in enumerate(texts):
        if x and all(len(grams(x) & grams(texts[j])) < t * len(grams(x) | grams(texts[j])) for j in out):
            out.append(i)
    return out


CASES = [
    FOX * 10,
    FOX * 10,
    FOX * 12,
    FOX * 10 + "A different sentence added here. " * 5,
    "Something that is entirely unrelated to the others. " * 10,
    None,
    "",
    "tiny",
    "tiny",
]


@pytest.mark.parametrize("method", ["exact", "minhash", "both", "fed", "lshbloom"])
def test_fox(spark, method):
    assert kept(dedup.near_dedup(frame(spark, CASES), method)) == [0, 3, 4, 7] == greedy(CASES)


def test_not_connected_components(spark):
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2000))
    a, b, c = body, body[160:], body[430:]
    texts = [a, b, c]
    assert greedy(texts) == [0, 2]  # a~b, b~c, not a~c
    assert kept(dedup.near_dedup(frame(spark, texts), "exact")) == [0, 2]


def test_random_edits_like_the_sequential_choice(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 300))) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(4):
            x = list(b)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice("XYZ")
            texts.append("".join(x))
    rng.shuffle(texts)
    assert kept(dedup.near_dedup(frame(spark, texts), "exact")) == greedy(texts)


def test_duplicate_map_and_stats(spark):
    df = frame(spark, CASES)
    rows = dedup.duplicate_map(dedup.similar_pairs(df)).collect()
    assert {(r["dup_id"], r["kept_id"]) for r in rows} == {(1, 0), (2, 0), (8, 7)}
    (s,) = dedup.dedup_stats(df, dedup.near_dedup(df, "exact")).collect()
    assert (s["total"], s["empty"], s["kept"], s["duplicates"]) == (9, 2, 4, 3)


def test_exact_dedup_keeps_first_by_order(spark):
    df = spark.createDataFrame([(1, 9, "a"), (2, 3, "a"), (3, 1, "b"), (4, 2, None)], "doc_id long, ord long, text string")
    for m in ("md5", "sha1", "sha256", "sha512"):
        assert kept(dedup.exact_dedup(df, order="ord", method=m)) == [2, 3]
    with pytest.raises(ValueError):
        dedup.exact_dedup(df, order="ord", method="crc")


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        dedup.near_dedup(frame(spark, ["a"]), "magic")


def test_empty_table(spark):
    assert dedup.near_dedup(frame(spark, []), "exact").count() == 0


def test_jaccard_goldens(spark):
    pairs = [(FOX * 10, FOX * 12, 1.0), (FOX * 10, CASES[3], 0.511), (FOX * 10, FOX * 10 + "Extra text " * 5, 0.672)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    rows = df.select(F.round(dedup.jaccard(shingles("a", 13), shingles("b", 13)), 3).alias("j")).collect()
    assert [r["j"] for r in rows] == [j for _, _, j in pairs]


def test_signature_estimates(spark):
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    b = a[:3600] + "".join(rng.choice("abcdefgh ") for _ in range(400))
    (r,) = spark.createDataFrame([(a, b)], "a string, b string").select(dedup.estimated_jaccard(dedup.signature(shingles("a", 13)), dedup.signature(shingles("b", 13))).alias("e")).collect()
    assert abs(r["e"] - len(grams(a) & grams(b)) / len(grams(a) | grams(b))) < 0.15


def test_bands_fit_threshold():
    b, r = dedup.bands_and_rows(0.8, 128)
    assert b * r <= 128 and 0.7 < (1 / b) ** (1 / r) < 0.9


def test_band_sketch_has_a_filter_per_band(spark):
    df = frame(spark, CASES).where("length(text) > 0").select(dedup.bloom_signature("text").alias("sig"))
    rows = dedup.band_sketch(df, "sig", 20, 6, expected=100).collect()
    assert sorted(r["band"] for r in rows) == list(range(20)) and all(any(r["filter"]) for r in rows)


def test_article_duplicates(spark):
    words = " ".join(f"word{i}" for i in range(200))
    df = frame(spark, [words, words, words + " tail", "other " * 30, None])
    assert sorted(r["doc_id"] for r in dedup.article_duplicates(df, "doc_id", "doc_id").collect()) == [1, 2]


def test_minhash_finds_pairs_at_the_threshold(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(400))
        texts += [a, a + "".join(rng.choice("qrstuvwxyz") for _ in range(90))]  # 388 of 478 runs: 0.81
    pairs = {m: {(r["lo"]["key"], r["hi"]["key"]) for r in dedup.similar_pairs(frame(spark, texts), method=m).collect()} for m in ("exact", "minhash", "minhash_compat")}
    assert pairs["minhash"] == pairs["exact"] == {(2 * i, 2 * i + 1) for i in range(40)}
    assert len(pairs["minhash_compat"]) < 36


def test_articles_with_two_changed_words_are_duplicates(spark):
    a = [f"word{i}" for i in range(200)]
    b = [{60: "changed", 130: "altered"}.get(i, w) for i, w in enumerate(a)]
    df = frame(spark, [" ".join(a), " ".join(b)])  # 186 of 206 runs of five, 162 of 214 of thirteen
    assert kept(dedup.article_duplicates(df, "doc_id", "doc_id")) == [1]
    assert kept(dedup.article_duplicates(df, "doc_id", "doc_id", n=13)) == []
