"""Problem 6: token ids of every text by a public byte-level BPE tokenizer.

Distinct-word table. Spark splits a text into words by the tokenizer's pattern; each block of texts
becomes a list of its distinct words and the place in that list of every word. The words of all
blocks meet by an equi-join on the word, where each distinct word is encoded once; the ids come back
to the block by place and are laid out in the order of the texts. Only distinct words per block and
one integer a word are shuffled, never the words of the texts. A block is bounded in words and in bytes.

The Java pattern is the tokenizer's with \\s written out. A text with characters that Java does not
know (\\p{Cn}) goes to the tokenizer itself, since the classes of such characters may differ.

Defined cases: a null text and an empty text give an empty list; strings that look like special
tokens are ordinary text; a lone word of any length is encoded whole; rows repeat freely, those without a key are left out; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.runs import column
from millrace.functions.tokenizer import RANKS, encoding, parsed, ranks_file
from millrace.session import cut

_SPACE = r"\t-\r \x{85}\p{Z}"
JAVA_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Words of a block at most, and bytes of them; one text that is longer is a block of its own.
BLOCK_WORDS, BLOCK_BYTES = 2_000_000, 64 << 20


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for b in batches:
        words = b.column("words")
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        size = np.concatenate([[0], np.cumsum(pc.binary_length(words.flatten()).to_numpy(zero_copy_only=False).astype(np.int64))])[ends]
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + BLOCK_WORDS, "right"))
            stop = max(start + 1, min(stop, int(np.searchsorted(size, (size[start - 1] if start else 0) + BLOCK_BYTES, "right"))))
            flat = words.slice(start, stop - start).flatten()
            coded = flat.dictionary_encode()
            keys = b.column("key").slice(start, stop - start).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + number], pa.int64()),
                    pa.array([keys.astype(np.int64).tobytes()], pa.binary()),
                    pa.array([lengths[start:stop].astype(np.int32).tobytes()], pa.binary()),
                    pa.array([coded.indices.to_numpy(zero_copy_only=False).astype(np.int32).tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string())),
                ],
                names=["block", "keys", "lengths", "places", "words"],
            )
            number += 1
            start = stop


def _encode_words(ranks: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoding(ranks.value)._encode_single_piece
        last, last_ids = None, None  # rows are sorted by word: each is encoded once
        for b in batches:
            coded = b.column("word").dictionary_encode()
            ids = []
            for w in coded.dictionary.to_pylist():
                if w != last:
                    last, last_ids = w, one(w)
                ids.append(last_ids)
            at = coded.indices
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("place"), pa.array(ids, pa.list_(pa.int32())).take(at)], names=["block", "place", "ids"])

    return rows


def ragged(places: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that lay out the pieces starts[p] : starts[p]+lengths[p] for each p of places."""
    n = lengths[places]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[places] - (ends - n), n)


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            keys, n_words, places = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("keys", np.int64), ("lengths", np.int32), ("places", np.int32)))
            entry = b.column("entries")[i].values if b.column("entries")[i].is_valid else None
            if entry is None or not len(places):
                yield pa.RecordBatch.from_arrays([keys, pa.array([[]] * len(keys), pa.list_(pa.int32()))], names=["key", "ids"])
                continue
            at, ids = entry.field("place").to_numpy(), entry.field("ids")
            length = pc.list_value_length(ids).to_numpy()
            flat = ids.flatten().to_numpy()
            first = np.cumsum(length) - length
            starts, lengths = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            starts[at], lengths[at] = first, length
            words_before = np.concatenate([[0], np.cumsum(n_words)])
            step = max(1, int(np.searchsorted(words_before, 400_000)))
            for a in range(0, len(keys), step):
                z = min(a + step, len(keys))
                part = places[words_before[a] : words_before[z]]
                out = flat[ragged(part, starts, lengths)]
                tokens = np.concatenate([[0], np.cumsum(lengths[part])])[words_before[a : z + 1] - words_before[a]]
                yield pa.RecordBatch.from_arrays([keys[a:z], pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(out, pa.int32()))], names=["key", "ids"])


def _directly(ranks: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks.value).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([encode(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], names=["key", "ids"])

    return rows


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(key, ids): the token ids of every row's text."""
    spark = df.sparkSession
    file = spark.sparkContext.broadcast(ranks_file(spark, ranks))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    odd = F.coalesce((F.octet_length("text") != F.length("text")) & F.col("text").rlike(r"\p{Cn}"), F.lit(False))
    words = rows.select("key", F.when(~odd, F.regexp_extract_all("text", F.lit(JAVA_PATTERN), F.lit(0))).alias("words"), odd.alias("odd")).where("NOT odd").drop("odd")
    blocks = cut(words.mapInArrow(_blocks, "block long, keys binary, lengths binary, places binary, words array<string>"))
    each = blocks.select("block", F.posexplode("words").alias("place", "word"))
    coded = each.repartition("word").sortWithinPartitions("word").mapInArrow(_encode_words(file), "block long, place int, ids array<int>")
    entries = coded.groupBy("block").agg(F.collect_list(F.struct("place", "ids")).alias("entries"))
    laid = blocks.drop("words").join(entries, "block", "left").mapInArrow(_lay_out, "key long, ids array<int>")
    direct = rows.where(odd).mapInArrow(_directly(file), "key long, ids array<int>")
    return laid.unionByName(direct).withColumnRenamed("key", key)


def vocabulary(spark: SparkSession, ranks: str = RANKS) -> DataFrame:
    """(id, piece): the bytes of each token; as many rows as the tokenizer's fixed vocabulary has."""
    rows = [(number, bytearray(piece)) for piece, number in parsed(ranks_file(spark, ranks)).items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode_corpus(coded: DataFrame, key: str = "doc_id", ranks: str = RANKS) -> DataFrame:
    """(key, text): the texts of lists of ids, through an equi-join of ids and pieces."""
    each = coded.select(key, F.posexplode("ids").alias("place", "id"))
    pieces = each.join(F.broadcast(vocabulary(coded.sparkSession, ranks)), "id")
    texts = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", F.hex("piece").alias("piece")))).alias("pieces"))
    texts = texts.select(key, F.decode(F.unhex(F.array_join(F.col("pieces.piece"), "")), "UTF-8").alias("text"))
    return coded.select(key).join(texts, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(key, n_tokens) where only the number is wanted: nothing is shuffled."""
    file = df.sparkSession.sparkContext.broadcast(ranks_file(df.sparkSession, ranks))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(file.value).encode_ordinary
        for b in batches:
            n = np.array([len(encode(t)) if t else 0 for t in b.column("text").to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays([b.column("key"), n], names=["key", "n_tokens"])

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(rows, "key long, n_tokens int").withColumnRenamed("key", key)
