"""Problems 1, 4 and 8 against brute force."""

import random
from itertools import combinations

import pytest

from millrace.functions import similar
from millrace.llm import lookalikes, near_duplicates, shared_spans

RNG = random.Random(5)


def noise(n, alphabet="abcdefghijklmnop qrstuvwxyz."):
    return "".join(RNG.choice(alphabet) for _ in range(n))


def edited(t, n):
    x = list(t)
    for _ in range(n):
        i = RNG.randrange(len(x))
        x[i : i + 1] = RNG.choice([["Z"], [], [x[i], "Q"]])
    return "".join(x)


def frame(spark, texts, key="ord"):
    # columns that clash with the operators' own names
    rows = [(i, t, i % 3, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"{key} long, text string, n int, tid string, key string")


BASE = [noise(RNG.randint(200, 900)) for _ in range(8)]
TEXTS = [None, "", "   ", "short", noise(199), *BASE, *[edited(b, k) for b in BASE for k in (1, 3, 8, 20)], BASE[0], BASE[0], BASE[3][:400] + BASE[3][420:], "é🙂" * 150, "é🙂" * 150 + "x", "a" * 5000, "a" * 5100]


def jaccard_pairs(texts, t=0.8):
    sets = {i: {x[j : j + 13] for j in range(len(x) - 12)} for i, x in enumerate(texts) if x and len(x) >= 200}
    return {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


@pytest.mark.parametrize("hot", [4096, 2])
def test_near_duplicates(spark, hot):
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(frame(spark, TEXTS), hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs(TEXTS)


def test_near_duplicate_links(spark):
    rows = {r["id"]: r for r in near_duplicates.near_duplicate_links(frame(spark, TEXTS)).collect()}
    assert len(rows) == len(TEXTS) and rows[0]["text_class"] is None and rows[3]["n_links"] == 0
    first = {t: TEXTS.index(t) for t in TEXTS if t and len(t) >= 200}
    links = {tuple(sorted((first[TEXTS[a]], first[TEXTS[b]]))) for a, b in jaccard_pairs(TEXTS) if TEXTS[a] != TEXTS[b]}
    for i, r in rows.items():
        if r["text_class"] is not None:
            assert r["text_class"] == first[TEXTS[i]] and r["n_links"] == sum(first[TEXTS[i]] in p for p in links)


@pytest.mark.parametrize("operator", [near_duplicates.near_duplicate_pairs, lookalikes.lookalike_pairs])
def test_texts_with_the_same_first_hash_stay_apart(spark, monkeypatch, operator):
    from pyspark.sql import functions as F

    from millrace.functions import groups

    texts = [*TEXTS, *[t.replace("a", "а") for t in TEXTS[5:9]]]
    want = {tuple(r) for r in operator(frame(spark, texts)).collect()}
    monkeypatch.setattr(groups, "first_hash", lambda c: (F.length(c) % 7).cast("long"))
    got = [tuple(r) for r in operator(frame(spark, texts)).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_links_can_be_rebuilt(spark):
    classes = near_duplicates.near_duplicate_classes(frame(spark, TEXTS)).collect()
    first = {t: TEXTS.index(t) for t in TEXTS if t and len(t) >= 200}
    assert {(r["class_a"], r["class_b"]) for r in classes} == {tuple(sorted((first[TEXTS[a]], first[TEXTS[b]]))) for a, b in jaccard_pairs(TEXTS) if TEXTS[a] != TEXTS[b]}
    groups = {r["id"]: r["group_id"] for r in near_duplicates.near_duplicate_links(frame(spark, TEXTS)).collect()}
    for a, b in jaccard_pairs(TEXTS):
        assert groups[a] == groups[b]
    assert groups[0] is None and groups[5] == 5


def test_reordered_parts_are_near(spark):
    parts = [noise(400) for _ in range(4)]
    texts = ["".join(parts), "".join(parts[::-1])]
    assert near_duplicates.near_duplicate_pairs(frame(spark, texts)).collect() == [(0, 1)]


def test_tiles_find_all_pairs_in_the_radius():
    import numpy as np

    g = np.random.default_rng(1)
    n = np.sort(g.integers(100, 400, 700)).astype(np.int32)
    s = g.integers(0, 1 << 63, (700, 2)).astype(np.uint64)
    s[1::2] = s[0::2] ^ np.uint64(5)
    got = set()
    for i, j in similar.tiled_pairs(n, np.arange(700), s[:, 0], s[:, 1], 0, 700, 0.8, 40):
        got |= set(zip(i.tolist(), j.tolist()))
    bits = lambda a, b: bin(int(s[a, 0]) ^ int(s[b, 0])).count("1") + bin(int(s[a, 1]) ^ int(s[b, 1])).count("1")
    assert got == {(a, b) for a, b in combinations(range(700), 2) if n[a] >= 0.8 * n[b] and bits(a, b) <= 40}


@pytest.mark.parametrize("operator", [near_duplicates.near_duplicate_pairs, lookalikes.lookalike_pairs, shared_spans.sharing_records])
def test_empty_table(spark, operator):
    assert operator(frame(spark, []), key="ord").count() == 0


PASSAGE = [noise(200), noise(199), noise(650)]
DOCS = [
    None,
    "",
    noise(300),
    noise(100) + PASSAGE[0] + noise(50),
    PASSAGE[0] + noise(400),
    noise(70) + PASSAGE[1] + noise(70),
    noise(30) + PASSAGE[1] + noise(30),
    noise(20) + PASSAGE[2] + noise(20) + PASSAGE[2],
    PASSAGE[2][100:500] + noise(500),
    PASSAGE[2][:210] + noise(100) + PASSAGE[0],
    "x" * 260,
    noise(40) + "x" * 230,
    "x" * 199,
    noise(500),
]
DOCS.append(DOCS[-1])


def span_pairs(texts, n=200):
    sets = {i: {x[j : j + n] for j in range(len(x) - n + 1)} for i, x in enumerate(texts) if x}
    return {(a, b) for a, b in combinations(sets, 2) if sets[a] & sets[b]}


@pytest.mark.parametrize("hot", [4096, 1])
def test_shared_spans(spark, hot):
    got = [tuple(r) for r in shared_spans.sharing_records(frame(spark, DOCS, "doc_id"), hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == span_pairs(DOCS)


@pytest.mark.parametrize("hot", [4096, 1])
def test_shared_extent(spark, hot):
    rows = {r["doc_id"]: r for r in shared_spans.shared_extent(frame(spark, DOCS, "doc_id"), hot=hot).collect()}
    for i, t in enumerate(DOCS):
        elsewhere = {x[j : j + 200] for k, x in enumerate(DOCS) if x and k != i for j in range(len(x) - 199)}
        covered = {c for j in range(len(t or "") - 199) if t[j : j + 200] in elsewhere for c in range(j, j + 200)}
        assert rows[i]["shared_chars"] == len(covered), i
        assert rows[i]["share"] == (None if not t else round(len(covered) / len(t), 6))


def test_lookalikes(spark):
    texts = [
        "The café is open", "The café is open", "Тhe café iѕ оpen", "The café is​ open", "Ｔｈｅ café is open", "the café is open", "The cafe is open",
        "The café  is open", "The café is\nopen", "ﬁne", "fine", None, "", " ", " ", "The café is open", "​",
    ]
    got = {tuple(r) for r in lookalikes.lookalike_pairs(frame(spark, texts)).collect()}
    same = [0, 1, 2, 3, 4, 15]
    assert got == {(a, b) for a, b in combinations(same, 2) if texts[a] != texts[b]} | {(9, 10)}
    forms = {r["ord"]: r["form"] for r in lookalikes.consistent_form(frame(spark, texts)).collect()}
    assert len(forms) == len(texts) and forms[11] is None and len({forms[i] for i in same}) == 1


def test_skeleton_is_stable():
    for t in ("Привет, мир", "Ελλάδα ΑΒΕ", "ﬀ½①", "ẛ̣", "👩‍🔬"):
        assert lookalikes.skeleton(lookalikes.skeleton(t)) == lookalikes.skeleton(t)
