"""Split groups, expanded pairs, components and exact text ids against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import groups

RNG = random.Random(3)
MEMBERS = [(i % 3 if i < 30 else 9, i) for i in range(100)]


@pytest.mark.parametrize("block", [7, 1000])
def test_pairs_within_and_expand_pairs(spark, block):
    rows = spark.createDataFrame(MEMBERS, "k long, id long")
    got = sorted(map(tuple, groups.pairs_within(rows, ["k"], "id", block).collect()))
    assert got == sorted((a, b) for k, a in MEMBERS for j, b in MEMBERS if k == j and a < b)
    links = [(0, 1), (0, 9), (1, 2)]
    got = groups.expand_pairs(spark.createDataFrame(links, "a long, b long"), rows.select("id", F.col("k").alias("tid")), block)
    assert sorted(map(tuple, got.collect())) == sorted((x, y) for a, b in links for k, x in MEMBERS for j, y in MEMBERS if k == a and j == b)


@pytest.mark.parametrize("block", [7, 1000])
def test_pairs_between(spark, block):
    rows = spark.createDataFrame(MEMBERS, "k long, id long")
    got = sorted(map(tuple, groups.pairs_between(rows.where("id % 3 = 1"), rows, ["k"], "id", block).distinct().collect()))
    assert got == sorted({(min(a, b), max(a, b)) for k, a in MEMBERS for j, b in MEMBERS if k == j and a % 3 == 1 and a != b})


@pytest.mark.parametrize("few", [1, 1000])
def test_salted_join(spark, monkeypatch, few):
    monkeypatch.setattr(groups, "SENT_ROWS", few)
    rows = spark.createDataFrame(MEMBERS, "k long, id long")
    labels = spark.createDataFrame([(0, "a"), (9, "b"), (7, "c")], "k long, label string")
    got = sorted(map(tuple, groups.salted_join(rows, labels, "k", "id").select("id", "label").collect()), key=str)
    assert got == sorted([(i, {0: "a", 9: "b"}.get(k)) for k, i in MEMBERS], key=str)


def test_components(spark):
    edges = [(RNG.randrange(200), RNG.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert groups.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_text_ids_are_exact(spark, monkeypatch):
    monkeypatch.setattr(groups, "first_hash", lambda c: F.length(c).cast("long"))
    rows = spark.createDataFrame([(i, "abc"[i % 3] * (i % 5)) for i in range(30)] + [(99, None)], "id long, text string")
    got = groups.with_text_id(rows).collect()
    assert len({r["tid"] for r in got if r["text"] is not None}) == len({r["text"] for r in got if r["text"] is not None})
