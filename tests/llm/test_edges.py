"""Empty tables, nulls in every column, repeated rows and columns with the operators' own names."""

import pytest

from millrace.llm import answer_defects, lookalikes, mixing, near_duplicates, packing, shared_spans, text_quality, tokenizing

LONG = "The long text goes on and on, and it is in the town as it was before. " * 400
TEXTS = [None, "", " \n", "x", LONG, LONG, LONG[:-1] + "!", "Ｗide " + LONG, "a" * 3000]
#: Names that the operators use themselves.
CLASH = "tid string, key string, value string, n int, rows int, a long, b long, covered string, state string, block string, size string, part string, _a string"


def frame(spark, key="ord", rows=True):
    data = [(i if i != 3 else None, t, *[None] * 13) for i, t in enumerate(TEXTS + TEXTS)] if rows else []
    return spark.createDataFrame(data, f"{key} long, text string, {CLASH}")


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("en", w) for w in "the and it is in as was".split()] + [(None, None), ("de", None)], "lang string, word string")


@pytest.mark.parametrize("rows", [True, False])
def test_texts(spark, words, rows):
    n = 2 * len(TEXTS) if rows else 0
    df = frame(spark, rows=rows)
    pairs = near_duplicates.near_duplicate_pairs(df).collect()
    assert all(r["id_a"] is not None and r["id_a"] < r["id_b"] for r in pairs) and bool(pairs) == rows
    assert near_duplicates.near_duplicate_links(df).count() == n
    assert bool(near_duplicates.near_duplicate_classes(df).collect()) == rows
    assert all(r["id_a"] < r["id_b"] for r in lookalikes.lookalike_pairs(df).collect())
    assert lookalikes.consistent_form(df).count() == n
    assert text_quality.quality_statistics(df, words).count() == n
    assert all(r["kind"] in ("junk", "list", "table") for r in text_quality.unnatural_texts(df, words).collect())
    shared = shared_spans.shared_extent(df, "ord").collect()
    assert len(shared) == n and all(r["shared_chars"] == r["chars"] for r in shared if r["ord"] is not None and (r["chars"] or 0) >= 3000)
    assert all(r["id_a"] < r["id_b"] for r in shared_spans.sharing_records(df, "ord").collect())


@pytest.mark.parametrize("rows", [True, False])
def test_tokens_and_bins(spark, rows):
    df = frame(spark, "doc_id", rows)
    n = 2 * len(TEXTS) - 1 if rows else 0  # one has no key
    ids = tokenizing.encode_corpus(df)
    assert ids.count() == n and tokenizing.decode_corpus(ids).count() == n
    counts = tokenizing.token_counts(df)
    packed = packing.pack(counts).collect()
    per_bin: dict = {}
    for r in packed:
        if r["bin"] is not None:
            per_bin[r["bin"]] = per_bin.get(r["bin"], 0) + r["n"]
    assert len({r["doc_id"] for r in packed}) == n and all(v <= 2048 for v in per_bin.values())
    parts = packing.part_report(counts).collect()
    assert all(r["gap"] >= 0 for r in parts) and bool(parts) == rows
    assert packing.fill_report(packing.pack(counts)).count() == 1


def test_bins_of_full_pieces_are_unique(spark):
    sizes = spark.createDataFrame([(i % 3, 2048 * 5) for i in range(60)], "doc_id long, n_tokens int")
    got = [r["bin"] for r in packing.pack(sizes, part_rows=50).collect()]
    assert len(got) == len(set(got)) == 300


@pytest.mark.parametrize("rows", [True, False])
def test_answers(spark, words, rows):
    data = [(None, None, None, None, *[None] * 5), (1, None, LONG, "", *[None] * 5), (1, LONG, LONG, LONG, *[None] * 5), (2, "", "🙂", None, *[None] * 5)] if rows else []
    df = spark.createDataFrame(data, "pair_id long, prompt string, chosen string, rejected string, opening string, topic string, runs string, side string, answer string")
    got = answer_defects.answer_flags(df, words).collect()
    assert len(got) == 2 * len(data)
    if rows:
        assert sum(r["defect"] == "copy" for r in got) == 2 and sum(r["defect"] == "empty" for r in got) == 4


def test_mixtures(spark):
    sources = spark.createDataFrame([("m", " A ", None, 1.0, None), ("m", "a", None, 1.0, None), ("m", None, None, 1.0, None), (None, "a", None, 1.0, None), ("other", "a", None, None, None)], "mix string, name string, subset string, weight double, size string")
    mixes = spark.createDataFrame([("m", 1.0, 2), (None, 1.0, 2), ("other", None, None)], "mix string, size_factor double, max_repeats int")
    docs = spark.createDataFrame([(1, "A", 10, "x"), (None, "a", 10, "x"), (2, None, 5, "x"), (3, "a", None, "x"), (3, "a", 7, "x")], "doc_id long, source string, n_chars long, name string")
    for how in ("limit", "entropy", "weights"):
        plan = mixing.mixing_plan(docs, sources, mixes, how=how)
        taken = mixing.realise(docs, plan).collect()
        assert all(r["doc_id"] is not None and r["copies"] <= 2 for r in taken)
        assert mixing.actual_shares(mixing.realise(docs, plan), plan).count() == plan.count()
