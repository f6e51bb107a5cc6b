import pytest
from pyspark.sql import functions as F

from millrace.operators import arrays as A
from millrace.operators import conversation as C
from millrace.operators import metrics as M
from millrace.operators import sequence as S


def one(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(columns.values())], names)


def test_mtp(spark):
    (r,) = one(spark, ids=list(range(1, 9)), mask=[1] * 8).select(S.mtp_labels(F.col("ids"), F.col("mask")).alias("x")).collect()
    assert r["x"] == [[2, 3], [3, 4], [4, 5], [5, 6], [6, 7], [7, 8], [8, -100], [-100, -100]]


def test_padding_in_labels(spark):
    ids, mask = list(range(1, 65)) + [0] * 64, [1] * 64 + [0] * 64
    df = one(spark, ids=ids, mask=mask)
    (r,) = df.select(S.lm_labels(F.col("ids"), F.col("mask")).alias("l"), S.mtp_labels(F.col("ids"), F.col("mask"), compat=True).alias("c"), S.mtp_labels(F.col("ids"), F.col("mask")).alias("m")).collect()
    assert r["l"] == list(range(1, 65)) + [-100] * 64
    assert r["c"][63] == [0, -100] and r["m"][63] == [-100, -100] and r["c"][62][1] == -100


def test_no_tokens(spark):
    df = spark.createDataFrame([(None,), ("",), ("a b",)], "t string").select(S.word_ids(F.col("t")).alias("i"))
    rows = df.select(S.padded(F.col("i"), 3).alias("p"), S.attention_mask(F.col("i"), 3).alias("m"), S.mtp_labels(F.col("i"), F.col("i")).alias("x")).collect()
    assert rows[0]["p"] == [0, 0, 0] and rows[1]["m"] == [0, 0, 0] and rows[0]["x"] == [] and rows[2]["m"] == [1, 1, 0]


def test_prompt_mask(spark):
    ids, template = [100, 101, 200, 201, 202, 300, 301], [200, 201, 202]
    (r,) = one(spark, ids=ids, t=template).select(S.prompt_masked_labels(F.col("ids"), F.col("t")).alias("x")).collect()
    assert r["x"] == [-100, -100, 200, 201, 202, 300, 301]
    (r,) = one(spark, ids=ids, t=[9]).select(S.prompt_masked_labels(F.col("ids"), F.col("t")).alias("x")).collect()
    assert r["x"] == [-100] * 7


def test_modalities(spark):
    df = spark.createDataFrame([(0,), (99_999,), (100_000,), (110_000,), (111_000,), (127_999,), (128_000,), (None,)], "t long")
    assert [r[0] for r in df.select(S.modality(F.col("t"))).collect()] == ["text", "text", "audio", "special", "phoneme", "reserved", "unknown", None]
    with pytest.raises(ValueError):
        S.mode_ranges("video")


def test_shards(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    rows = S.contiguous_shards(df, "k", 3).orderBy("k").collect()
    assert [r["shard"] for r in rows] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_conversation_format(spark):
    rows = [([("system", "S"), ("user", "U"), ("tool", "T"), ("assistant", None)],), ([],), (None,)]
    df = spark.createDataFrame(rows, "m array<struct<role string, content string>>").select(C.format_conversation(F.col("m")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["### System: S\n\n### Human: U\n\n### Assistant: ", "", None]


def test_transcripts(spark):
    t = "\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant: d"
    rows = spark.createDataFrame([(t,), ("\n\nHuman: only",), ("abcd",), (None,)], "t string").select(C.extract_prompt(F.col("t")).alias("p"), C.extract_response(F.col("t")).alias("r")).collect()
    assert (rows[0]["p"], rows[0]["r"]) == ("\n\nHuman: a\n\nAssistant: b\n\nHuman: c", " d")
    assert rows[1]["p"] == "\n\nHuman: only" and (rows[2]["p"], rows[2]["r"]) == ("ab", "cd") and rows[3]["p"] is None


def test_scores_and_choice(spark):
    df = spark.createDataFrame([("h", "A", "B", 2.0, 1.0), ("h", "A", "B", 1.0, 1.0)], "history string, human_ref_A string, human_ref_B string, score_A double, score_B double")
    assert [r["chosen"] for r in C.from_scores(df).collect()] == ["A", "B"]


def test_probing(spark):
    df = spark.createDataFrame([("q", "x", "y"), ("q", "", "y"), (None, "x", "y")], "question string, better string, worse string")
    assert C.probe_preference(df).collect() == [("q", "x", "y")]
    with pytest.raises(ValueError):
        C.probe_preference(df.select("question"))
    with pytest.raises(ValueError):
        C.detect_conversation(df)


def test_alpaca_input(spark):
    df = spark.createDataFrame([("do", "this", "done")], "instruction string, input string, output string")
    (r,) = C.detect_conversation(df).collect()
    assert r["conversation"][0]["content"] == "do\n\nInput: this"


def test_load_window_golden(spark):
    rows = [(s, e, float(c)) for s in range(5) for e, c in enumerate((10, 15, 8, 12))]
    out = M.load_window(spark.createDataFrame(rows, "step int, expert int, n double"), "step", "expert", "n", 4, 10).where("step = 4").orderBy("expert").collect()
    assert [round(r["mean"], 6) for r in out] == [0.222222, 0.333333, 0.177778, 0.266667]
    assert all(round(r["std"], 6) == 0 and not r["under"] and not r["over"] for r in out)


def test_gae_like_the_loop(spark):
    rewards, values = [1.0, 0.5, -1.0, 2.0], [0.3, 0.2, 0.1, 0.4]
    (r,) = one(spark, r=rewards, v=values).select(M.gae(F.col("r"), F.col("v")).alias("g")).collect()
    out, g, n = [0.0] * 4, 0.0, 4
    for t in reversed(range(n - 1)):
        g = rewards[t] + 0.99 * (0 if t == n - 2 else values[t + 1]) - values[t] + 0.99 * 0.95 * g
        out[t] = g
    assert [round(x, 9) for x in r["g"]] == [round(x, 9) for x in out]


def test_empty_arrays(spark):
    df = spark.createDataFrame([([], [])], "a array<double>, b array<double>")
    (r,) = df.select(M.gae(F.col("a"), F.col("b")).alias("g"), A.top_k(F.col("a"), 3).alias("k"), A.nucleus(F.col("a"), 0.5).alias("n"), M.distinct_ratio(F.col("a")).alias("d"), A.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert r["g"] == [] and r["k"] == [] and r["n"] == [] and r["d"] is None and r["c"] is None


def test_pack_and_unpack(spark):
    df = spark.createDataFrame([("c", i, [float(i), float(-i)]) for i in range(5)], "clip string, frame int, features array<double>")
    packed = A.pack_frames(df, "clip", "frame", "features", 2)
    assert packed.where("pack = 2").collect()[0]["features"] == [4.0, -4.0, 0.0, 0.0]
    back = A.unpack_frames(packed, "clip", "pack", "features", 2).orderBy("frame").collect()
    assert [r["features"] for r in back[:5]] == [[float(i), float(-i)] for i in range(5)]
    assert A.packed_length(1601, 160, 4) == 3


def test_quantise_and_k_means(spark):
    rows = [(i, [float(i % 2) * 10 + i / 100, 0.0]) for i in range(20)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    centres = A.k_means(df, "v", 2, order="id")
    codes = {r["id"]: r["code"] for r in A.quantise(df, "v", centres).collect()}
    assert codes[99] is None and len({codes[i] for i in range(0, 20, 2)}) == 1 and codes[0] != codes[1]
