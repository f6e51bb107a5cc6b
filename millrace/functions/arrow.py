"""Arrow functions for what the JVM functions cannot express; each sees whole batches."""

from __future__ import annotations

import difflib
import html
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

from millrace.functions.rolling import distinct_shingles

#: What mis-decoded text is replaced by, in order. Later entries that share a prefix
#: with an earlier one never match; the order is part of the meaning.
MOJIBAKE = (
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€", '"'),
    ("â€”", "-"),
    ("â€“", "-"),
    ("â€¦", "..."),
    ("ï¬", "fi"),
    ("ï¬‚", "fl"),
)


def tidy(text: str, form: str | None, mojibake: bool, unescape: bool) -> str:
    """Normal form, mojibake repair and entities, in this order; plain ASCII passes untouched."""
    if not text.isascii():
        if form:
            text = unicodedata.normalize(form, text)
        if mojibake and ("â" in text or "ï" in text):
            for old, new in MOJIBAKE:
                text = text.replace(old, new)
    return html.unescape(text) if unescape and "&" in text else text


def tidied(c: Column | str, form: str | None = "NFKC", mojibake: bool = True, unescape: bool = True) -> Column:
    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else tidy(t, form, mojibake, unescape) for t in texts.to_pylist()], pa.string())

    return run(c)


def shingles(c: Column | str, n: int) -> Column:
    """Sorted distinct 64-bit hashes of the runs of n characters; a shorter text is one run, an empty one none."""

    @F.arrow_udf(ArrayType(LongType()))
    def run(texts: pa.Array) -> pa.Array:
        sets = []
        for t in texts.to_pylist():
            sets.append(np.empty(0, np.int64) if not t else np.sort(distinct_shingles(t, min(n, len(t))).view(np.int64)))
        ends = np.cumsum([0, *map(len, sets)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))

    return run(c)


def distinct_runs(c: Column | str, n: int) -> Column:
    """How many different runs of n characters a text has."""

    @F.arrow_udf(LongType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else len(distinct_shingles(t, n)) for t in texts.to_pylist()], pa.int64())

    return run(c)


def matcher_ratio(a: Column | str, b: Column | str) -> Column:
    """Share of characters in matching blocks of two texts."""

    @F.arrow_udf(DoubleType())
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    return run(a, b)


def top_shares(c: Column | str) -> Column:
    """struct(letters, words): share of the most frequent letter and of the most frequent word, 0 if none."""
    from pyspark.sql.types import StructField, StructType

    @F.arrow_udf(StructType([StructField("letters", DoubleType()), StructField("words", DoubleType())]))
    def run(texts: pa.Array) -> pa.Array:
        letters, words = [], []
        for t in texts.to_pylist():
            by_word = Counter((t or "").split())
            total = sum(by_word.values())
            words.append(max(by_word.values()) / total if total else 0.0)
            by_letter: Counter = Counter()
            for w, n in by_word.items():  # each different word once
                for ch in w:
                    by_letter[ch] += n
            counts = [n for ch, n in by_letter.items() if ch.isalpha()]
            letters.append(max(counts) / sum(counts) if counts else 0.0)
        return pa.StructArray.from_arrays([pa.array(letters, pa.float64()), pa.array(words, pa.float64())], names=["letters", "words"])

    return run(c)
