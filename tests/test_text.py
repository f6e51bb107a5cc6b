"""Cleaning, filters, quality and domains against plain Python."""

import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions.arrow import MOJIBAKE
from millrace.operators import cleaning, domains, filters, quality

TEXTS = [
    None,
    "",
    " \n ",
    "plain text",
    "ﬁne ™ café &amp; &lt;b&gt;   x\u0007y\r\n\n\n\nend ",
    "â€™s â€œquoted",
    "a\tb c\u0085d",
    "emoji 🙂 \x7f\x9f tail",
    "x" * 30_000 + " (unclosed",
    'balanced ({[]}) "quotes"',
]


def python_clean(t):
    t = unicodedata.normalize("NFKC", t)
    if not t.isascii():
        for old, new in MOJIBAKE:
            t = t.replace(old, new)
    t = html.unescape(t)
    t = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "", t)
    return re.sub(r"\s+", " ", t).strip()


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


def test_clean_like_python(spark):
    rows = frame(spark).select("id", cleaning.clean("text", compat=True).alias("c")).collect()
    for r in rows:
        t = TEXTS[r["id"]]
        assert r["c"] == (None if t is None else python_clean(t))


def test_clean_keeps_lines_by_default(spark):
    (r,) = frame(spark, ["a  b \n\n\n\n c\r\nd"]).select(cleaning.clean("text").alias("c")).collect()
    assert r["c"] == "a b\n\nc\nd"


def test_cleaning_stats_of_nothing(spark):
    (r,) = cleaning.cleaning_stats(frame(spark, []), "text", "text").collect()
    assert r["documents"] == 0 and r["removed_share"] == 0


def test_article_cleaning(spark):
    t = "Intro <b>bold</b> [[Category:Birds]] text {{cite web}}.\n== References ==\nall gone"
    (r,) = frame(spark, [t]).select(cleaning.clean_article("text").alias("c")).collect()
    assert r["c"] == "Intro bold text . "[:-1] + "" or r["c"].startswith("Intro bold text")
    assert "gone" not in r["c"]


def test_balance(spark):
    cases = ["", "()", "([)]", "((", "{[()]}", '"', '""', ")("]
    rows = frame(spark, cases).select("id", filters.balanced(F.col("text")).alias("b")).collect()
    assert {cases[r["id"]]: r["b"] for r in rows} == {"": True, "()": True, "([)]": False, "((": False, "{[()]}": True, '"': False, '""': True, ")(": False}


def test_first_failing_reason_wins(spark):
    good = "\n".join(f"Line number {i} tells of thing {i * 7919}" for i in range(30))
    cases = {"x": "doc_length", "!" * 40: "doc_length", "y" * 150: "line_filters", "ab\n" * 60: "repetition", None: "doc_length", good: None, good + " (": "unbalanced"}
    rows = filters.heuristic_filter(frame(spark, list(cases)), limits=filters.HeuristicLimits(max_run_repetition=0.9)).collect()
    assert {r["text"]: r["reject_reason"] for r in rows} == cases


def test_filter_stats(spark):
    (r,) = filters.filter_stats(filters.heuristic_filter(frame(spark, ["x", "y"]))).collect()
    assert r["total"] == 2 and r["rejected"] == 2 and r["reason_counts"] == {"doc_length": 2}


def test_reasons_of_empty_table(spark):
    assert filters.reason_counts(filters.heuristic_filter(frame(spark, []))).count() == 0


@pytest.mark.parametrize("products, passes", [((0.8, 0.9), True), ((0.8, 0.8), False)])
def test_penalties_multiply(products, passes):
    out = 1.0
    for p in products:
        out *= p
    assert (out >= 0.7) == passes


def test_top_share(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), ([],), (["c"],)], "x array<string>").select(F.round(filters.top_share(F.col("x")), 4).alias("s")).collect()
    assert [r["s"] for r in rows] == [0.6667, 0.0, 1.0]


def test_quality_score(spark):
    rows = frame(spark, ["", None, "short", "word " * 60]).select("id", F.round(quality.heuristic_score(F.col("text")), 6).alias("s")).orderBy("id").collect()
    assert [r["s"] for r in rows] == [0.0, 0.0, 0.3, 0.5]


def test_ensemble_needs_a_score():
    with pytest.raises(ValueError):
        quality.ensemble()


def test_perplexity_prefers_known_text(spark):
    train = frame(spark, ["the cat sat on the mat"] * 20)
    rows = quality.perplexity(frame(spark, ["the cat sat", "mat the on cat", "", None]), quality.pair_counts(train), "id").orderBy("id").collect()
    p = [r["perplexity"] for r in rows]
    assert p[0] < p[1] and p[2] == p[3] == 500.0


def test_classifier_learns(spark):
    rows = [(i, f"good solid sentence number {i}" if i % 2 else f"buy cheap pills now {i}", float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, label double")
    model = quality.train_classifier(df.where("id < 40"), features=1 << 10)
    held = quality.classifier_score(df.where("id >= 40"), model).collect()
    assert sum((r["score"] > 0.5) == (r["label"] == 1) for r in held) >= 18


def test_domains(spark):
    cases = [
        ("def hello():\n    import os\n    return os", "code"),
        ("Abstract. We prove. Introduction et al. citation hypothesis", "academic"),
        ("[[Link]] == Head == Category: birds", "wikipedia"),
        ("Just some words about nothing.", "common_crawl"),
        (None, "common_crawl"),
    ]
    rows = domains.classify(frame(spark, [c for c, _ in cases]), method="keyword").orderBy("id").collect()
    assert [r["domain_found"] for r in rows] == [d for _, d in cases]
    assert rows[3]["domain_confidence"] == 0.5
    df = spark.createDataFrame([(1, "def f(): import x", "books"), (2, "def f(): import x", None)], "id long, text string, domain string")
    assert [(r["domain_found"], r["domain_confidence"]) for r in domains.classify(df, label="domain", method="metadata").orderBy("id").collect()] == [("books", 1.0), ("common_crawl", 0.3)]
    with pytest.raises(ValueError):
        domains.classify(df, method="magic")
