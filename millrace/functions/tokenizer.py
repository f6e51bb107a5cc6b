"""A public byte-level BPE tokenizer: its file is read on the driver and sent to the tasks."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern of the tokenizer's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks_file(spark: SparkSession, path: str = RANKS) -> bytes:
    """The tokenizer's file of fixed size, read on the driver; executors get its bytes, not its path."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    return Path(path).read_bytes()


def parsed(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}


@cache
def encoding(ranks: bytes):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=parsed(ranks), special_tokens={})


def bpe_ids(spark: SparkSession, path: str = RANKS) -> Callable[[Column], Column]:
    """A function from a text column to its token ids; null and empty texts have none, special tokens are ordinary text."""
    file = spark.sparkContext.broadcast(ranks_file(spark, path))

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoding(file.value).encode_ordinary
        return pa.array([encode(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids


def bpe_text(spark: SparkSession, path: str = RANKS) -> Callable[[Column], Column]:
    """A function from a column of token ids to the text they stand for."""
    file = spark.sparkContext.broadcast(ranks_file(spark, path))

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        decode = encoding(file.value).decode_bytes
        return pa.array([None if i is None else decode(i).decode("utf-8", "replace") for i in ids.to_pylist()], pa.string())

    return text
