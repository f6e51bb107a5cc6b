"""Conversations and preference pairs: readers' shapes, templates, prompts and answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.sequence import attention_mask, padded

#: What stands before a turn, by role.
TEMPLATES = {"system": "### System:", "user": "### Human:", "assistant": "### Assistant:"}
PROMPT_FIELDS = ("prompt", "context", "question", "input", "text")
PAIR_FIELDS = (("chosen", "rejected"), ("response_chosen", "response_rejected"), ("positive", "negative"), ("better", "worse"))
ASSISTANT, HUMAN = "\n\nAssistant:", "\n\nHuman:"


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def from_messages(messages: Column) -> Column:
    """Turns with a role and a content."""
    return F.filter(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull())


def from_instruction(instruction: Column, output: Column, system: Column | None = None) -> Column:
    """Conversation of an optional system text, an instruction or question, and its answer."""
    turns = [turn("system", system)] if system is not None else []
    return F.filter(F.array(*turns, turn("user", instruction), turn("assistant", output)), lambda m: m["content"].isNotNull() & (m["content"] != ""))


def detect_conversation(df: DataFrame) -> DataFrame:
    """df with `conversation`, by the columns it has: conversation, messages, instruction and output,
    question and response, prompt and response, or text; else an error."""
    c = set(df.columns)
    system = next((F.col(s) for s in ("system", "system_prompt") if s in c), None)
    if "conversation" in c:
        return df
    if "messages" in c:
        return df.withColumn("conversation", from_messages(F.col("messages")))
    if {"instruction", "input", "output"} <= c:
        asked = F.when(F.coalesce(F.col("input"), F.lit("")) != "", F.concat(F.col("instruction"), F.lit("\n\nInput: "), F.col("input"))).otherwise(F.col("instruction"))
        return df.withColumn("conversation", from_instruction(asked, F.col("output"), system))
    for a, b in (("instruction", "output"), ("question", "response"), ("prompt", "response")):
        if {a, b} <= c:
            return df.withColumn("conversation", from_instruction(F.col(a), F.col(b), system))
    if "text" in c:
        return df.withColumn("conversation", text_to_conversation(F.col("text")))
    raise ValueError(f"no conversation in columns {sorted(c)}")


def format_conversation(conversation: Column, templates: dict[str, str] | None = None) -> Column:
    """Template and content of each turn, joined by a blank line; other roles are left out."""
    t = templates or TEMPLATES
    known = F.filter(conversation, lambda m: m["role"].isin(*t))

    def line(m: Column) -> Column:
        head = reduce(lambda w, kv: w.when(m["role"] == kv[0], kv[1]), list(t.items())[1:], F.when(m["role"] == next(iter(t)), t[next(iter(t))]))
        return F.concat(head, F.lit(" "), F.coalesce(m["content"], F.lit("")))

    return F.array_join(F.transform(known, line), "\n\n")


def collect_turns(df: DataFrame, key: str, order: str, role: str = "role", content: str = "text") -> DataFrame:
    """(key, conversation) of rows of one turn each, in order; a conversation is one row in the end."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return df.groupBy(key).agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("conversation"))


def text_to_conversation(c: Column, response: str = TEMPLATES["assistant"]) -> Column:
    """The first two parts around the response template; the whole text as user without one."""
    parts = F.split(c, r"\Q" + response + r"\E")
    second = F.try_element_at(parts, F.lit(2))
    both = F.array(turn("user", F.trim(F.element_at(parts, 1))), turn("assistant", F.trim(second)))
    return F.when(second.isNotNull(), both).otherwise(F.array(turn("user", c)))


def extract_prompt(c: Column) -> Column:
    """All before the last answer of a transcript, else its last human turn, else the first half."""
    a = F.split(c, ASSISTANT)
    h = F.split(c, HUMAN)
    half = F.left(c, F.floor(F.length(c) / 2).cast("int"))
    return (
        F.when(F.size(a) > 1, F.array_join(F.slice(a, F.lit(1), F.size(a) - 1), ASSISTANT))
        .when(F.size(h) > 1, F.concat(F.lit(HUMAN), F.element_at(h, -1)))
        .otherwise(half)
    )


def extract_response(c: Column) -> Column:
    """The last answer of a transcript, else the second half."""
    a = F.split(c, ASSISTANT)
    return F.when(F.size(a) > 1, F.element_at(a, -1)).otherwise(F.substring(c, F.floor(F.length(c) / 2).cast("int") + 1, F.length(c)))


def from_transcripts(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    return df.select(extract_prompt(F.col(chosen)).alias("prompt"), extract_response(F.col(chosen)).alias("chosen"), extract_response(F.col(rejected)).alias("rejected"))


def from_scores(df: DataFrame, prompt: str = "history", a: str = "human_ref_A", b: str = "human_ref_B", score_a: str = "score_A", score_b: str = "score_B") -> DataFrame:
    """A is chosen exactly if its score is higher; a tie chooses B."""
    wins = F.coalesce(F.col(score_a) > F.col(score_b), F.lit(False))
    return df.select(F.col(prompt).alias("prompt"), F.when(wins, F.col(a)).otherwise(F.col(b)).alias("chosen"), F.when(wins, F.col(b)).otherwise(F.col(a)).alias("rejected"))


def from_choice(df: DataFrame, prompt: Column, first: Column, second: Column, choice: Column) -> DataFrame:
    """The first is chosen if choice is 0."""
    wins = choice == 0
    return df.select(prompt.alias("prompt"), F.when(wins, first).otherwise(second).alias("chosen"), F.when(wins, second).otherwise(first).alias("rejected"))


def probe_preference(df: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected) of the first known columns there are; rows with an empty one are left out."""
    present = [c for c in PROMPT_FIELDS if c in df.columns]
    pairs = [p for p in PAIR_FIELDS if set(p) <= set(df.columns)]
    if not present or not pairs:
        raise ValueError(f"no preference pair in columns {df.columns}")
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return df.select(full(present[0]).alias("prompt"), full(pairs[0][0]).alias("chosen"), full(pairs[0][1]).alias("rejected")).dropna()


def pair_texts(prompt: Column, response: Column, max_prompt: int) -> Column:
    """Prompt, cut to max_prompt characters, a blank line, and the response."""
    return F.concat(F.left(F.coalesce(prompt, F.lit("")), F.lit(max_prompt)), F.lit("\n\n"), F.coalesce(response, F.lit("")))


def encode_pairs(df: DataFrame, ids: Callable[[Column], Column], length: int = 2048, prompt: str = "prompt", sides: tuple[str, str] = ("chosen", "rejected")) -> DataFrame:
    """df with prompt_ids (at most half of length), and for each side its ids of prompt, blank line and
    answer, padded to length, and their mask. ids turns a text column into token ids."""
    out = df.withColumn("prompt_ids", F.slice(ids(F.coalesce(F.col(prompt), F.lit(""))), F.lit(1), F.lit(length // 2)))
    for side in sides:
        both = F.concat(F.coalesce(F.col(prompt), F.lit("")), F.lit("\n\n"), F.coalesce(F.col(side), F.lit("")))
        out = out.withColumn(f"_{side}", ids(both))
        out = out.withColumn(f"{side}_ids", padded(F.col(f"_{side}"), length)).withColumn(f"{side}_mask", attention_mask(F.col(f"_{side}"), length)).drop(f"_{side}")
    return out


def pointwise(df: DataFrame, key: str) -> DataFrame:
    """(key, side, prompt, response, reward): chosen 1, rejected 0."""
    return df.select(key, "prompt", F.explode(F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("response"), F.lit(1.0).alias("reward")),
        F.struct(F.lit("rejected").alias("side"), F.col("rejected").alias("response"), F.lit(0.0).alias("reward")),
    )).alias("r")).select(key, "r.side", "prompt", "r.response", "r.reward")


def role_counts(df: DataFrame, messages: str = "messages") -> DataFrame:
    turns = df.select(F.explode(messages).alias("m"))
    return turns.groupBy(F.col("m.role").alias("role")).agg(F.count("*").alias("turns"), F.sum(F.length("m.content")).alias("chars"))
