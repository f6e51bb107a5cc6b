"""Language of a text by its character triples.

Whole texts are judged; head=200 looks at the first 200 characters, as the described rule does. Texts
with fewer than 50 characters have no language. The model is bounded: the most frequent triples of each
language, counted over all labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

HEAD, LEAST, TRIPLES = 200, 50, 400


def triples(text: str, head: int | None = None) -> list[str]:
    t = f" {' '.join((text if head is None else text[:head]).lower().split())} "
    return [t[i : i + 3] for i in range(len(t) - 2)]


def train(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = TRIPLES, head: int | None = None) -> dict[str, dict[str, float]]:
    """Log probabilities of each language's triples, '' for any other; labels in lower case, their first part."""
    label = F.split(F.lower(F.trim(lang)), "-")[0]
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) >= LEAST)).select(label.alias("lang"), F.col(text).alias("text"))

    def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, Counter] = defaultdict(Counter)
            for one, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                n[one].update(triples(t, head))
            flat = [(k, t, c) for k, found in n.items() for t, c in found.items()]
            columns = list(zip(*flat)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["lang", "t", "n"])

    counts = rows.mapInArrow(added_up, "lang string, t string, n long").groupBy("lang", "t").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "t"))
    model: dict[str, dict[str, float]] = defaultdict(dict)
    for r in counts.select("lang", "t", "n", total.alias("all"), rank.alias("r")).where(F.col("r") <= per_language).collect():  # per_language rows a language
        model[r["lang"]][r["t"]] = math.log(r["n"] / r["all"])
        model[r["lang"]].setdefault("", math.log(0.3 / r["all"]))
    return dict(model)


def identify(c: Column | str, model: dict[str, dict[str, float]], head: int | None = None) -> Column:
    """struct(lang, confidence), both null for a text that is null or too short."""
    names = sorted(model, reverse=True)  # of equal scores the last name wins
    known = {t: i for i, t in enumerate(sorted({t for p in model.values() for t in p if t}), 1)}
    weight = np.array([[model[k][""] for k in names]] + [[model[k].get(t, model[k][""]) for k in names] for t in known]).reshape(-1, max(1, len(names)))

    @F.arrow_udf(StructType([StructField("lang", StringType()), StructField("confidence", DoubleType())]))
    def run(texts: pa.Array) -> pa.Array:
        langs, sure = [], []
        for t in texts.to_pylist():
            if t is None or len(t) < LEAST or not names:
                langs.append(None), sure.append(None)
                continue
            found = np.bincount([known.get(x, 0) for x in triples(t, head)], minlength=len(weight))
            score = found @ weight
            best = int(score.argmax())
            langs.append(names[best])
            sure.append(float(1 / np.exp(np.minimum(0.0, score - score[best])).sum()))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=["lang", "confidence"])

    return run(c)


def in_language(c: Column | str, model: dict[str, dict[str, float]], lang: str = "en", confidence: float = 0.95) -> Column:
    found = identify(c, model)
    return F.coalesce((found["lang"] == lang) & (found["confidence"] >= confidence), F.lit(False))
