"""Table functions for SQL: register(spark), then SELECT ... FROM t, LATERAL text_runs(text, 13)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="run: string", useArrow=True)
class TextRuns:
    """Every different run of n characters of a text once; a shorter text is one run, a null or empty one none."""

    def eval(self, text: str, n: int) -> Iterator[tuple[str]]:
        if text:
            for run in {text[i : i + n] for i in range(max(1, len(text) - n + 1))}:
                yield (run,)


@udtf(returnType="band: int, key: string", useArrow=True)
class SignatureBands:
    """The bands of a signature, each as one key; places that fill no whole band are left out."""

    def eval(self, signature: list, bands: int, rows: int) -> Iterator[tuple[int, str]]:
        if signature is not None:
            for i in range(min(bands, len(signature) // rows)):
                yield i, ",".join(str(v) for v in signature[i * rows : (i + 1) * rows])


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_runs", TextRuns)
    spark.udtf.register("signature_bands", SignatureBands)
