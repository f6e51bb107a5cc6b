"""Queries of token sequences, conversations and preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.chars import SPACE
from millrace.functions.tokenizer import bpe_ids, bpe_text
from millrace.operators import conversation as C
from millrace.operators import sequence as S
from millrace.plans.registry import query
from millrace.session import table

L = 2048  # the length of training sequences
IDS = f"list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> ''), lambda w: CAST(CAST('0x' || left(md5(w), 7) AS BIGINT) % 50000 AS INT))"
SEQ_SQL = f"""WITH a AS (SELECT doc_id, {IDS} AS all_ids FROM documents),
b AS (SELECT doc_id, list_slice(all_ids, 1, {L}) AS kept FROM a),
s AS (SELECT doc_id, list_transform(range(1, {L} + 1), lambda i: CASE WHEN i <= len(kept) THEN kept[i] ELSE 0 END) AS ids,
  list_transform(range(1, {L} + 1), lambda i: CASE WHEN i <= len(kept) THEN 1 ELSE 0 END) AS mask FROM b)
"""


def _seq(spark, d):
    rows = table(spark, d, "documents").select("doc_id", S.word_ids(F.col("text")).alias("all_ids"))
    return rows.select("doc_id", S.padded(F.col("all_ids"), L).alias("ids"), S.attention_mask(F.col("all_ids"), L).alias("mask"))


@query(SEQ_SQL + "SELECT doc_id, ids, mask FROM s")
def token_sequences(spark, d):
    return _seq(spark, d)


@query(SEQ_SQL + "SELECT doc_id, list_transform(ids, lambda i: least(i, 29999)) AS ids FROM s")
def token_clamp(spark, d):
    return _seq(spark, d).select("doc_id", S.clamp_ids(F.col("ids"), 30_000).alias("ids"))


@query(SEQ_SQL + f"SELECT doc_id, list_transform(range(1, {L} + 1), lambda i: CASE WHEN mask[i] = 0 THEN -100 ELSE ids[i] END) AS labels FROM s")
def lm_labels(spark, d):
    return _seq(spark, d).select("doc_id", S.lm_labels(F.col("ids"), F.col("mask")).alias("labels"))


MTP = f"SELECT doc_id, list_transform(range(1, {L} + 1), lambda i: [CASE WHEN mask[i] = 1 AND i + 1 <= {L} {{}} THEN ids[i + 1] ELSE -100 END, CASE WHEN mask[i] = 1 AND i + 2 <= {L} AND mask[i + 2] = 1 THEN ids[i + 2] ELSE -100 END]) AS labels FROM s"


@query(SEQ_SQL + MTP.format("AND mask[i + 1] = 1"))
def mtp_labels(spark, d):
    return _seq(spark, d).select("doc_id", S.mtp_labels(F.col("ids"), F.col("mask")).alias("labels"))


@query(SEQ_SQL + MTP.format(""))
def mtp_labels_compat(spark, d):
    return _seq(spark, d).select("doc_id", S.mtp_labels(F.col("ids"), F.col("mask"), compat=True).alias("labels"))


@query(SEQ_SQL + "SELECT CAST(sum(len(all_ids)) AS BIGINT) AS tokens, count(*) AS rows FROM a")
def token_count(spark, d):
    """Tokens of whole texts."""
    return S.count_tokens(table(spark, d, "documents").select(F.transform(S.word_ids(F.col("text")), lambda _: F.lit(1)).alias("mask")), "mask")


@query(
    SEQ_SQL
    + f""", p AS (SELECT doc_id, ids, coalesce(list_min(list_filter(range(2, {L}), lambda i: ids[i] = ids[5] AND ids[i + 1] = ids[6])), {L + 1}) AS first FROM s)
SELECT doc_id, list_transform(range(1, {L} + 1), lambda i: CASE WHEN i < first THEN -100 ELSE ids[i] END) AS labels FROM p"""
)
def prompt_mask(spark, d):
    return _seq(spark, d).select("doc_id", S.prompt_masked_labels(F.col("ids"), F.slice("ids", 5, 2)).alias("labels"))


@query("SELECT event_id, CASE WHEN t < 100000 THEN 'text' WHEN t < 110000 THEN 'audio' WHEN t < 111000 THEN 'special' WHEN t < 116000 THEN 'phoneme' WHEN t < 128000 THEN 'reserved' ELSE 'unknown' END AS modality FROM (SELECT event_id, event_id * 37 % 130000 AS t FROM events)")
def token_modality(spark, d):
    return table(spark, d, "events").select("event_id", S.modality(F.col("event_id") * 37 % 130_000).alias("modality"))


@query("SELECT event_id, (t BETWEEN 50262 AND 51285) OR t IN (1, 2, 3) AS allowed FROM (SELECT event_id, event_id * 37 % 130000 AS t FROM events)")
def token_allowed(spark, d):
    return table(spark, d, "events").select("event_id", S.allowed(F.col("event_id") * 37 % 130_000, S.mode_ranges("spec"), [1, 2, 3]).alias("allowed"))


@query("SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN i - 1 BETWEEN 8 AND 15 OR i - 1 = 3 THEN embedding[i]::DOUBLE ELSE -1e9::DOUBLE END) AS masked FROM embeddings")
def logit_mask(spark, d):
    return table(spark, d, "embeddings").select("vec_id", S.mask_values(F.col("embedding").cast("array<double>"), [(8, 16)], [3], -1e9).alias("masked"))


@query("SELECT doc_id, CAST(least((row_number() OVER (ORDER BY doc_id) - 1) // greatest((SELECT count(*) FROM documents) // 7, 1), 6) AS INT) AS shard FROM documents")
def shard_assign(spark, d):
    return S.contiguous_shards(table(spark, d, "documents").select("doc_id"), "doc_id", 7)


@query(
    """SELECT conv_id, array_to_string(list_transform(list_filter(messages, lambda m: m.role IN ('system', 'user', 'assistant')),
  lambda m: CASE m.role WHEN 'system' THEN '### System:' WHEN 'user' THEN '### Human:' ELSE '### Assistant:' END || ' ' || coalesce(m.content, '')), chr(10) || chr(10)) AS text FROM chat_messages"""
)
def sft_format(spark, d):
    return table(spark, d, "chat_messages").select("conv_id", C.format_conversation(F.col("messages")).alias("text"))


@query("SELECT conv_id, len(list_filter(messages, lambda m: m.role IS NOT NULL AND m.content IS NOT NULL)) AS turns FROM chat_messages")
def sft_messages(spark, d):
    rows = C.detect_conversation(table(spark, d, "chat_messages"))
    return rows.select("conv_id", F.when(F.col("messages").isNotNull(), F.size("conversation")).alias("turns"))


@query("SELECT m.role AS role, count(*) AS turns, CAST(sum(length(m.content)) AS BIGINT) AS chars FROM (SELECT unnest(messages) AS m FROM chat_messages) GROUP BY 1")
def role_counts(spark, d):
    return C.role_counts(table(spark, d, "chat_messages"))


@query(
    """WITH t AS (SELECT conv_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM chat_messages)
SELECT conv_id, string_agg(coalesce(m.role, '?'), ',' ORDER BY i) AS roles FROM t GROUP BY conv_id"""
)
def collect_turns(spark, d):
    rows = table(spark, d, "chat_messages").select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", "turn", "m.role", F.col("m.content").alias("text"))
    out = C.collect_turns(rows, "conv_id", "turn")
    return out.select("conv_id", F.array_join(F.transform("conversation", lambda t: F.coalesce(t["role"], F.lit("?"))), ",").alias("roles"))


A, H = "chr(10) || chr(10) || 'Assistant:'", "chr(10) || chr(10) || 'Human:'"
T = "coalesce(prompt, '') || chr(10) || chr(10) || CASE WHEN pair_id % 3 = 0 THEN 'Assistant:' ELSE '' END || coalesce(chosen, '')"


@query(
    f"""WITH t AS (SELECT pair_id, {T} AS t FROM preference), p AS (SELECT pair_id, t, string_split(t, {A}) AS a, string_split(t, {H}) AS h FROM t)
SELECT pair_id, CASE WHEN len(a) > 1 THEN array_to_string(list_slice(a, 1, len(a) - 1), {A}) WHEN len(h) > 1 THEN {H} || h[len(h)] ELSE left(t, length(t) // 2) END AS prompt,
  CASE WHEN len(a) > 1 THEN a[len(a)] ELSE substr(t, length(t) // 2 + 1) END AS response FROM p"""
)
def prompt_response(spark, d):
    joined = F.concat(F.coalesce("prompt", F.lit("")), F.lit("\n\n"), F.when(F.col("pair_id") % 3 == 0, "Assistant:").otherwise(""), F.coalesce("chosen", F.lit("")))
    rows = table(spark, d, "preference").select("pair_id", joined.alias("t"))
    return rows.select("pair_id", C.extract_prompt(F.col("t")).alias("prompt"), C.extract_response(F.col("t")).alias("response"))


@query("SELECT prompt, chosen, rejected FROM preference WHERE prompt <> '' AND chosen <> '' AND rejected <> ''")
def pref_pairs(spark, d):
    return C.probe_preference(table(spark, d, "preference"))


@query("SELECT dataset AS prompt, CASE WHEN coalesce(annotator > pair_id % 5, false) THEN chosen ELSE rejected END AS chosen, CASE WHEN coalesce(annotator > pair_id % 5, false) THEN rejected ELSE chosen END AS rejected FROM preference")
def pref_scored(spark, d):
    return C.from_scores(table(spark, d, "preference").withColumn("other", F.col("pair_id") % 5), "dataset", "chosen", "rejected", "annotator", "other")


@query("SELECT pair_id, side, prompt, response, reward FROM (SELECT pair_id, 'chosen' AS side, prompt, chosen AS response, 1.0::DOUBLE AS reward FROM preference UNION ALL SELECT pair_id, 'rejected', prompt, rejected, 0.0::DOUBLE FROM preference)")
def reward_rows(spark, d):
    return C.pointwise(table(spark, d, "preference"), "pair_id")


@query("SELECT pair_id, left(coalesce(prompt, ''), 100) || chr(10) || chr(10) || coalesce(chosen, '') AS text FROM preference")
def pair_texts(spark, d):
    return table(spark, d, "preference").select("pair_id", C.pair_texts(F.col("prompt"), F.col("chosen"), 100).alias("text"))


R = "'### Assistant:'"
TALK = f"CASE WHEN pair_id % 3 = 0 THEN prompt ELSE coalesce(prompt, '') || {R} || coalesce(chosen, '') END"


@query(
    f"""WITH t AS (SELECT pair_id, {TALK} AS t FROM preference), p AS (SELECT pair_id, t, string_split(t, {R}) AS p FROM t)
SELECT pair_id, CASE WHEN len(p) > 1 THEN trim(p[1], ' ') ELSE t END AS user, CASE WHEN len(p) > 1 THEN trim(p[2], ' ') END AS assistant FROM p WHERE t IS NOT NULL"""
)
def text_to_conversation(spark, d):
    talk = F.when(F.col("pair_id") % 3 == 0, F.col("prompt")).otherwise(F.concat(F.coalesce("prompt", F.lit("")), F.lit("### Assistant:"), F.coalesce("chosen", F.lit(""))))
    rows = table(spark, d, "preference").select("pair_id", talk.alias("t")).where("t IS NOT NULL").select("pair_id", C.text_to_conversation(F.col("t")).alias("c"))
    return rows.select("pair_id", F.col("c")[0]["content"].alias("user"), F.try_element_at("c", F.lit(2))["content"].alias("assistant"))


@query("SELECT pair_id, prompt, CASE WHEN coalesce(annotator % 2 = 0, false) THEN chosen ELSE rejected END AS chosen, CASE WHEN coalesce(annotator % 2 = 0, false) THEN rejected ELSE chosen END AS rejected FROM preference")
def pref_choice(spark, d):
    rows = table(spark, d, "preference")
    choice = F.coalesce(F.col("annotator") % 2, F.lit(1))
    # the key goes along in the prompt's struct
    out = C.from_choice(rows, F.struct("pair_id", "prompt"), F.col("chosen"), F.col("rejected"), choice)
    return out.select("prompt.pair_id", "prompt.prompt", "chosen", "rejected")


@query("SELECT pair_id, coalesce(prompt, '') AS prompt, coalesce(prompt, '') || chr(10) || chr(10) || coalesce(chosen, '') AS chosen, coalesce(prompt, '') || chr(10) || chr(10) || coalesce(rejected, '') AS rejected FROM preference")
def pair_tokens(spark, d):
    """Pairs as ids of a byte-level tokenizer, and what the ids within the masks stand for."""
    ids, text = bpe_ids(spark), bpe_text(spark)
    rows = C.encode_pairs(table(spark, d, "preference"), ids, 8192)
    inside = lambda side: text(F.slice(f"{side}_ids", F.lit(1), F.aggregate(f"{side}_mask", F.lit(0), lambda s, x: s + x)))
    return rows.select("pair_id", text(F.col("prompt_ids")).alias("prompt"), inside("chosen").alias("chosen"), inside("rejected").alias("rejected"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def bpe_round_trip(spark, d):
    ids, text = bpe_ids(spark), bpe_text(spark)
    return table(spark, d, "documents").select("doc_id", text(ids(F.col("text"))).alias("text"))
