"""Problems 2, 3, 5, 6 and 7 on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import answer_defects, mixing, packing, text_quality, tokenizing

WORDS = [("en", w) for w in "the of and to in a is was it this that with as on for you".split()] + [("de", w) for w in "der die das und ist war nicht es von im mit".split()] + [("fr", w) for w in "le la les de et est en un une pas dans".split()]
WORDS += [("es", w) for w in "el la los de y es en no un una con".split()] + [("ru", w) for w in "и в не на что это".split()]


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame(WORDS, "lang string, word string")


ANSWERS = [
    ("Why is the sky blue?", None, "empty"),
    ("Why is the sky blue?", " ​\n", "empty"),
    ("Why is the sky blue?", "[no response]", "empty"),
    ("Why is the sky blue?", "Assistant:", "empty"),
    ("Why is the sky blue?", "No", None),
    ("Why is the sky blue?", "WHY IS THE SKY BLUE", "copy"),
    ("Why is the sky blue?", "You asked: Why is the sky blue?", "copy"),
    ("Why is the sky blue?", "Why is the sky blue? It is because of the way light is scattered in the air.", None),
    ("Why is the sky blue?", "I'm sorry, but I can't help with that.", "refusal"),
    ("Why is the sea salty?", "As an AI language model, I must decline.", "refusal"),
    ("Write a polite note with which Ann turns down an offer from Bob.", "Thank you. I'm sorry, but I have to decline this time. It was a kind offer.", None),
    ("Why is the sky blue?", "I can't recommend it enough. It is the best of the skies that was seen in this town.", None),
    ("Why is the sky blue?", "Der Himmel ist blau und das ist nicht die Frage von der es im Buch war.", "other_language"),
    ("Translate into German: the house is in the town", "Das Haus ist nicht in der Stadt und die Stadt war mit der Bahn.", None),
    ("Translate into German: the house is in the town", "La maison est dans la ville et les rues de la ville est une place.", "other_language"),
    ("Why is the sky blue?", "It is because of the air. The light that is scattered in the", "truncated"),
    ("Why is the sky blue?", "Look:\n```\nx = [1, 2,", "truncated"),
    ("Why is the sky blue?", "- light blue\n- dark blue\n- no blue", None),
    (None, "It is because of the air and the light in it.", None),
    ("", "It is because of the air and the light in it.", None),
]


def test_answers(spark, common):
    rows = [(i, p, a, "It is fine as it is, and this was the answer.", "extra") for i, (p, a, _) in enumerate(ANSWERS)]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, chosen string, rejected string, topic string")
    got = {r["pair_id"]: r["defect"] for r in answer_defects.defective_answers(df, common).collect() if r["side"] == "chosen"}
    assert got == {i: d for i, (_, _, d) in enumerate(ANSWERS) if d}
    assert answer_defects.defective_answers(df.limit(0), common).count() == 0
    assert answer_defects.answer_flags(df.union(df), common).count() == 4 * len(rows)


def test_template_without_own_words_is_a_refusal_by_its_cluster(spark, common):
    say = "Regrettably the assistant {} answer such a question here today, so please ask something else instead of it."
    rows = [(i, f"Question number {i} about topic {i * 31}?", say.format("cannot" if i else "will never"), "Fine. It is the answer.") for i in range(8)]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, chosen string, rejected string")
    flags = answer_defects.answer_flags(df, common).where("side = 'chosen'").collect()
    assert all(r["template"] for r in flags if r["pair_id"])


def test_recurrence_makes_a_refusal_without_listed_words(spark, common):
    say = "Regrettably the assistant {} answer such a question here today, so please ask something else instead of it."
    other = "Such matters lie beyond the remit that this {} assistant was once given, so some other {} may be raised with me instead."
    odd = "amber birch cedar delta ember fjord grove heath".split()
    rows = [(i, f"Where is number {i} of the {w} houses?", say.format("cannot" if i else "will never"), other.format(w[::-1], odd[i - 1][::-1])) for i, w in enumerate(odd)]
    rows += [(10 + i, f"Where is number {i} of the {w} houses?", "Fine. It is so, as it was before.", f"My view on the {w} houses is that it was so in the town.") for i, w in enumerate(odd)]
    rows += [(20, "Write a letter that declines an offer.", other.format("kind", "thing"), "Fine. It is.")]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, chosen string, rejected string")
    assert not any(answer_defects.declines(r[3]) for r in rows) and not answer_defects.declines(rows[0][2])
    got = {(r["pair_id"], r["side"]): r["defect"] for r in answer_defects.defective_answers(df, common).collect()}
    assert got == {(i, s): "refusal" for i in range(8) for s in ("chosen", "rejected")}


TOPICS = "amber birch cedar delta ember fjord grove heath island jetty kelp lagoon".split()


def flags(spark, common, rows):
    df = spark.createDataFrame([(i, p, a, "Fine. It is the answer, as it was before.") for i, (p, a) in enumerate(rows)], "pair_id long, prompt string, chosen string, rejected string")
    return {r["pair_id"]: (r["defect"], r["template"]) for r in answer_defects.answer_flags(df, common).where("side = 'chosen'").collect()}


def test_a_template_outside_the_list_is_a_refusal(spark, common):
    say = "Sorry, that's a topic I stay away from."
    assert not answer_defects.declines(say)
    got = flags(spark, common, [(f"Where is the {w} of the town?", say) for w in TOPICS])
    assert set(got.values()) == {("refusal", True)}


def test_a_long_refusal_is_one(spark, common):
    say = "I can't help with that request. " + "There are many reasons for it, and people may come to harm by what is said here to them today. " * 4 + "If you like, please ask me something else."
    assert len(say.split()) > 80
    got = flags(spark, common, [(f"Where is the {w} of the town?", say) for w in TOPICS])
    assert set(got.values()) == {("refusal", True)}


def test_a_template_that_answers_is_none(spark, common):
    say = "As an AI I am glad of it. The {0} is in the town, and the {0} was built of {0} wood with {0} walls and a {0} roof by the sea."
    got = flags(spark, common, [(f"Where is the {w}?", say.format(w)) for w in TOPICS])
    assert {d for d, _ in got.values()} == {None}


def test_openings_in_a_chain_are_one_cluster(spark):
    import itertools

    r = random.Random(2)
    chain = [[r.randrange(1 << 40) for _ in range(20)]]
    for i in range(40):  # each differs a little from the one before, so the ends have nothing in common
        new = list(chain[-1])
        new[i % 20] = r.randrange(1 << 40)
        chain.append(new)
    alone = [[r.randrange(1 << 40) for _ in range(20)] for _ in range(10)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(chain + alone)], "opening long, runs array<long>").cache()
    got = {r["opening"]: r["cluster"] for r in answer_defects.opening_clusters(rows).collect()}
    linked = [(a, b) for a, b in itertools.combinations(range(41), 2) if len(set(chain[a]) & set(chain[b])) >= 0.8 * len(set(chain[a]) | set(chain[b]))]
    assert len(linked) >= 40 and all(got[a] == got[b] for a, b in linked)
    assert {got[41 + i] for i in range(10)} == set(range(41, 51))


def test_runs_of_openings():
    words = ["a b c d e f".split(), ["x"], [], "a b c d e".split(), "w w w w w w w".split()]
    got = answer_defects.runs_of(words).to_pylist()
    assert [len(x) for x in got] == [2, 1, 0, 1, 1] and got[3][0] in got[0]


def test_what_may_decline_covers_what_declines():
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = [a.lower() for _, a, _ in ANSWERS if a] + ["не могу вам с этим помочь", "je ne suis pas autorisée à", "no estoy autorizada", "ich kann dir dabei leider nicht helfen"]
    may = pc.match_substring_regex(pa.array(texts), answer_defects._MAY_DECLINE).to_pylist()
    assert all(m for m, t in zip(may, texts) if answer_defects._DECLINES.search(t)) and sum(may) >= 6


def test_refusals_are_told_by_all_sentences():
    usual = {w for _, w in WORDS}
    turn = "How is a lock opened without its key?"
    late = "Hello there. Thank you for writing to me today. I can't help with that."
    long = "I can't help with that. " + "There are reasons for it, as harm may come to people and to what they own. " * 5 + "If you like, I could tell you about gardens, music, old maps or trains instead."
    content = "Some doors have one. The lock of a door is opened with a pick and a small wrench. " + "The lock is turned by the wrench and the pins of the lock are lifted. " * 5 + "I can't help with rust in it."
    quoted = "A lock is opened by a smith. The smith came to the lock. The smith said \"I can't help with this lock\" and went."
    after = "I can't share photos here, but words will do. " + "The lock is turned by the wrench, and its pins are lifted with a pick. " * 6
    got = [answer_defects.declines(a, turn, usual) for a in (late, long, content, quoted, after)]
    assert got == [True, True, False, False, False]


def test_languages_are_asked_for_anywhere_in_the_turn():
    article = "The book was written in French and sold in the town. It was read to the end of the year."
    ends = "Answer in German, please, and keep your answer to at most three sentences, without lists or headings"
    cases = {
        f"Human: {article}\n\n{ends}": ["de"],
        f"{article}\n\nNow reply in Spanish to the people of the town.\n\n{article}": ["es"],
        f"{article} {article}": [],
        "What is it?\n\n" + article + "\n\nHe said \"please answer in Russian\" to us.": [],
        "Bitte antworte auf Englisch und halte dich dabei an höchstens drei kurze Sätze ohne Listen und ohne Überschriften": ["en"],
        "How do you say this in Spanish? The house is in the town.": ["es"],
        "Please give me the Russian version of: the house": ["ru"],
    }
    assert {t: answer_defects.asked_languages(answer_defects.last_turn(t)) for t in cases} == cases
    common: dict = {}
    for lang, w in WORDS:
        common.setdefault(lang, set()).add(w)
    german = "Das Haus ist nicht in der Stadt und die Stadt war mit der Bahn."
    turn = f"{article}\n\n{ends}"
    asked = lambda t: answer_defects.Asked(t, answer_defects.by_word(common))
    assert not answer_defects.is_other_language(german, asked(turn))
    assert answer_defects.is_other_language("It is the house that was in the town as it is.", asked(turn))


def test_kinds(spark, common):
    prose = "This is the story of a house that was in the town, and it was as old as the hills. It is told for you. "
    rng = random.Random(2)
    rand = lambda n: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n))
    cases = {
        prose * 1 + "You see that it is with us on this day, for the sake of the people and of all that is in it, as it was.": None,
        "\n".join(f"- item {w}" for w in "red green blue black white grey pink brown gold silver amber violet olive teal navy coral ivory".split() * 2): "list",
        "\n".join(f"{i},{i * 7},name{i},{i / 3:.2f}" for i in range(30)): "table",
        "\n".join(f"| {i} | n{i} | {i * 3} |" for i in range(30)): "table",
        " ".join(rand(rng.randint(3, 9)) for _ in range(60)): "junk",
        "seasonal hull 123 " * 40: "junk",
        " ".join(f"{rng.randrange(256):02x}" for _ in range(150)): "junk",
        "def f(x):\n    y = x + 1\n    if y > 3:\n        return y\n    return x\n\n" * 4 + "for i in range(3):\n    print(f(i))\n" * 3: None,
        "short": None,
        "": None,
    }
    texts = list(cases)
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(99, None, 0)], "ord long, text string, kind int")
    got = {r["ord"]: r["kind"] for r in text_quality.unnatural_texts(df, common).collect()}
    assert got == {i: cases[t] for i, t in enumerate(texts) if cases[t]}
    stats = {r["ord"]: r for r in text_quality.quality_statistics(df, common).collect()}
    assert len(stats) == len(texts) + 1 and stats[99]["words"] == 0 and stats[99]["common_share"] is None
    assert {i: r["kind"] for i, r in stats.items() if r["kind"]} == got


def test_lines_with_common_words_are_still_judged():
    common = frozenset(w for _, w in WORDS)
    rare = [f"{a}{b}" for a in "grubal tenfor mospin velcar dunrit".split() for b in "ane ilo ust erk omb ady ift olm ung eph ikt aro ews".split()]
    prose = "this is the story of a house that stood in the town for years with all doors open wide as it was when the people of those hills first came here on foot."
    assert text_quality.shares(" ".join([prose, *rare]), common)[2] > 0.5
    rng = random.Random(3)
    some = lambda n: ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n)]
    row = lambda a, b, c, *rest: "\t".join([f"{a} of {b}", f"in {c}", *rest])
    assert text_quality.shares("\n".join(row(*some(10)) for _ in range(12)), common)[1] == 1.0
    item = lambda a, b, *rest: f"- {a} of {b} in {' '.join(rest)}"
    items = [l for l in (item(*some(7)) for _ in range(60)) if 60 < len(l) <= 80]
    assert len(items) > 5 and text_quality.shares("\n".join(items), common)[0] == 1.0


def test_line_lengths_decide_lists():
    word = iter(f"{a}{b}{c}o" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst").__next__
    prose = [" ".join(word() for _ in range(6)).ljust(40, "x")[:40] for _ in range(9)]
    items = [" ".join(word() for _ in range(2 + i % 3)) for i in range(12)]
    entries = [l for _ in range(8) for l in (word(), "   " + " ".join(word() for _ in range(6)))]
    assert text_quality.is_wrapped(prose) and not text_quality.is_list(prose, [l.split() for l in prose])
    assert text_quality.regularity(items)[1] <= 3 and text_quality.is_list(items, [l.split() for l in items])
    assert text_quality.regularity(entries)[1] == 2 and text_quality.regularity(entries)[0] > 0.9 > 0.6 > text_quality.autocorrelation(np.array([4.0, 40.0] * 8), 1)
    assert text_quality.shares("\n".join(entries), frozenset(["the"]))[0] > 0.5


def test_noise_beside_common_words_is_junk():
    common = frozenset(w for _, w in WORDS)
    made_up = [f"{a}{b}{c}u" for a in "bdfgkl" for b in "aeiou" for c in "mnp"][:85]
    assert text_quality.shares(" ".join(sorted(common)[:13] + made_up) + ".", common)[2] > 0.5
    assert text_quality.shares("This was it and that is the house on you. " * 3 + "a\x01b\x02" * 60, common)[2] > 0.5


def test_statistics():
    n, mean, symbols, ended, share = text_quality.statistics("The cat sat.\n\nOn the mat", frozenset({"the", "on"}))
    assert n == 6 and mean == 17 / 6 and round(symbols, 4) == round(1 / 24, 4) and ended == 0.5 and share == 0.5


ODD = [None, "", " ", "hello world", "  two  spaces\n\n\tand tabs ", "<|endoftext|> is text", "don't we'll I'm", "x" * 5000, "1234567 ½ ²", "日本語のテキスト", "👩‍🔬🏽 emoji", "a b　c d\x85e\x1cf", "tail   ", "͸ unknown", "ẞ Ǆ ﬁ"]


def test_ids_like_the_tokenizer(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(ODD * 2)], "doc_id long, text string, key string")
    coded = tokenizing.encode_corpus(df)
    rows = {r["doc_id"]: r["ids"] for r in coded.collect()}
    for i, x in enumerate(ODD * 2):
        assert rows[i] == t.encode(x or "", add_special_tokens=False).ids, x
    back = {r["doc_id"]: r["text"] for r in tokenizing.decode_corpus(coded).collect()}
    assert back == {i: x or "" for i, x in enumerate(ODD * 2)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokenizing.token_counts(df).collect()}
    assert counts == {i: len(v) for i, v in rows.items()}
    assert tokenizing.encode_corpus(df.limit(0)).count() == 0


@pytest.mark.parametrize("part_rows", [20_000, 40])
def test_packing(spark, part_rows):
    rng = random.Random(3)
    sizes = [None, 0, 100, 101, 250, 1] + [rng.randint(1, 99) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens int")
    rows = packing.pack(df, capacity=100, part_rows=part_rows).collect()
    load, of = {}, {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append((r["start"], r["n"]))
        if r["bin"] is not None:
            load[r["bin"]] = load.get(r["bin"], 0) + r["n"]
    assert max(load.values()) <= 100
    for k, s in enumerate(sizes):
        assert sum(n for _, n in of[k]) == (s or 0) and len(of[k]) == max(1, -(-(s or 0) // 100))
    (rep,) = packing.fill_report(packing.pack(df, capacity=100, part_rows=part_rows), 100).collect()
    assert rep["bound"] <= rep["bins"] == len(load) <= rep["bound"] * (1.05 if part_rows > 40 else 1.2) + 2


def test_bounds_hold():
    rng = random.Random(9)
    import numpy as np

    for _ in range(50):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 60))), reverse=True)
        bins = max(packing.best_fit_decreasing(sizes, 100)) + 1
        assert packing.lower_bound(np.bincount(sizes, minlength=101), 100) <= bins
    assert packing.lower_bound(np.bincount([60, 60, 60], minlength=101), 100) == 3


def mixture(spark):
    docs = [(i, "Big " if i % 2 else "big", 100) for i in range(40)] + [(100 + i, "SMALL", 50) for i in range(4)] + [(200, None, 70), (201, "other", 130), (202, "big", None)]
    sources = [("m", "big", "s", 3.0), ("m", " Small", "s", 1.0), ("m", " Small", "s", 1.0), ("m", "none", None, 0.5), ("m", "zero", None, None), ("lost", "big", None, 1.0)]
    return (
        spark.createDataFrame(docs, "doc_id long, source string, n_chars long"),
        spark.createDataFrame(sources, "mix string, name string, subset string, weight double"),
        spark.createDataFrame([("m", 1.0, 3)], "mix string, size_factor double, max_repeats int"),
    )


@pytest.mark.parametrize("block_rows", [2048, 4])
def test_mixing(spark, block_rows):
    docs, sources, mixes = mixture(spark)
    plan = mixing.mixing_plan(docs, sources, mixes)
    assert sorted(map(tuple, mixing.unreachable(plan).collect())) == [("m", "none"), ("m", "small")]
    rows = mixing.realise(docs, plan, block_rows=block_rows).collect()
    total = 40 * 100 + 4 * 50 + 200
    taken = {n: sum(r["size"] * r["copies"] for r in rows if r["name"] == n) for n in ("big", "small")}
    assert taken["small"] == 3 * 200 and max(r["copies"] for r in rows) <= 3
    assert total - 600 - 100 <= taken["big"] <= total - 600  # what the others cannot use
    shares = {r["name"]: r for r in mixing.actual_shares(mixing.realise(docs, plan), plan).collect()}
    assert shares["none"]["taken"] == 0 and round(sum(r["actual_share"] for r in shares.values()), 9) == 1


def test_exponents():
    natural, target = [0.8, 0.15, 0.05], [1 / 3] * 3
    assert mixing.tempered(natural, target, 0.0) == pytest.approx(natural)
    assert mixing.tempered(natural, target, 1.0) == pytest.approx(target)
    x = mixing.entropy_exponent(natural, 0.9)
    raw = [s**x for s in natural]
    assert mixing.entropy([r / sum(raw) for r in raw]) == pytest.approx(0.9, abs=1e-6)
    plan = mixing.plan_mixture([("a", 1.0, 800), ("b", 1.0, 150), ("c", 1.0, 50)], 1000, 1.0, 2)
    assert max(p["tempered"] * 1000 / p["size"] for p in plan) == pytest.approx(2, abs=1e-6)
    assert [p["name"] for p in plan if not p["reachable"]] == ["b", "c"]


def test_ways_to_plan():
    rows = [("a", 1.0, 800), ("b", 1.0, 150), ("c", 1.0, 50), ("gone", 1.0, 0), ("off", 0.0, 70)]
    for how in ("limit", "entropy", "weights"):
        plan = {p["name"]: p for p in mixing.plan_mixture(rows, 1000, 1.0, 2, how)}
        assert sum(p["budget"] for p in plan.values()) == pytest.approx(1000) and plan["gone"]["budget"] == plan["off"]["budget"] == 0
        assert all(p["budget"] <= 2 * p["size"] + 1e-6 for p in plan.values())
        assert {p["name"] for p in plan.values() if not p["reachable"]} == {"c", "gone"}
    assert plan["a"]["budget"] == pytest.approx(600) and plan["b"]["budget"] == pytest.approx(300)
    short = mixing.plan_mixture([("a", 1.0, 10), ("b", 3.0, 10)], 1000, 1.0, 2)
    assert [p["budget"] for p in short] == [20, 20] and [p["passes"] for p in short] == [2, 2]
    with pytest.raises(ValueError):
        mixing.plan_mixture(rows, 1000, 1.0, 2, "other")


def test_empty_mixture(spark):
    docs, sources, mixes = mixture(spark)
    plan = mixing.mixing_plan(docs.limit(0), sources, mixes)
    assert plan.count() == 4 and mixing.unreachable(plan).count() == 0 and mixing.realise(docs.limit(0), plan).count() == 0
    assert mixing.mixing_plan(docs, sources.limit(0), mixes).where(F.lit(True)).count() == 0
