import random
import string

import pytest

from millrace.operators import dedup
from millrace.plans import catalog
from millrace.session import cut_freed


def changed(rng, text, share):
    """text with about that share of runs of 13 broken by changed letters."""
    out = list(text)
    for i in rng.sample(range(len(out)), max(1, int(len(out) * share / 13))):
        out[i] = rng.choice("0123456789")
    return "".join(out)


def corpus(n, length, seed=3):
    """Unlike texts, and to every fourth a copy on either side of the threshold."""
    rng, texts = random.Random(seed), []
    while len(texts) < n:
        texts.append("".join(rng.choices(string.ascii_lowercase, k=rng.randint(length // 2, length))))
        if len(texts) % 4 == 0:
            texts.append(changed(rng, texts[-1], rng.uniform(0.02, 0.2)))
    return texts + [texts[0], "", None, "short", "short", "shorter than"]


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(list(enumerate(corpus(600, 2000))), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_thorough_finds_what_exact_finds(spark):
    df = spark.createDataFrame(list(enumerate(corpus(200, 120))), "doc_id long, text string")
    found = {m: {(r["lo"]["key"], r["hi"]["key"], r["jaccard"]) for r in dedup.similar_pairs(df, method=m).collect()} for m in ("exact", "thorough")}
    assert found["thorough"] == found["exact"] and len(found["exact"]) > 10
    kept = [sorted(r["doc_id"] for r in dedup.near_dedup(df, m).collect()) for m in ("exact", "thorough")]
    assert kept[0] == kept[1]


def test_cut_freed(spark):
    df = cut_freed(spark.range(1000).repartition(7, "id").groupBy().count())
    assert [r["count"] for r in df.collect()] == [1000] == [r["count"] for r in df.collect()]


@pytest.mark.parametrize("name", ["near_dup_pairs", "dup_map", "near_dup_survivors", "estimated_similarity"])
def test_shuffles_less_than_three_times_the_texts(spark, folder, name):
    size = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(length(text)) AS n").first()["n"]
    before = shuffled(spark)
    assert catalog.queries()[name](spark, folder).count() > 20
    assert shuffled(spark) - before < 3 * size
