"""Reading documents: paths before names, declared schemas, columns that are not known stay.

A source is a local path (jsonl, json, txt, parquet, arrow files, a directory of them) or a name in a
catalog of local paths. Bad JSON lines stay as rows with _corrupt_record instead of ending the job.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.chars import strip
from millrace.functions.groups import sent
from millrace.session import cut

DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])


def resolve(source: str, catalog: Mapping[str, str] | None = None) -> str:
    """A path that exists, else the path of the name in the catalog, else FileNotFoundError."""
    if Path(source).exists() or "://" in source:
        return source
    if catalog and source in catalog:
        return catalog[source]
    raise FileNotFoundError(f"no file and no known dataset: {source}")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = DOCUMENT) -> DataFrame:
    """With a schema, malformed lines give nulls and _corrupt_record; schema=None infers all columns."""
    if schema is None:
        return spark.read.json(path)
    full = schema if "_corrupt_record" in schema.names else T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, ord): every line that is not blank, stripped. ord orders lines by the path of their
    file and place in it; ids are doc_<n> in that order, from 0.

    A line's number is the count of lines in earlier blocks (parts of files that a task reads) and its
    rank in its own block; only the counts, a row for each block, are put in order together.
    """
    lines = spark.read.text(path).select(strip("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where("text <> ''")
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    per = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    per = cut(per.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    rows = lines.withColumn("rank", rank).join(sent(per), ["file", "block"])
    rows = rows.withColumn("ord", (F.col("before") + F.col("rank")).cast("long"))
    return rows.select(F.concat(F.lit("doc_"), F.col("ord").cast("string")).alias("id"), "text", "ord")


def read_arrow_files(spark: SparkSession, directory: str) -> DataFrame:
    """(id, text) of the rows with a text in all *.arrow files (up to 2 GB each) below a directory.

    Files come to the tasks through Spark, so the directory may be any that Spark can read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").option("recursiveFileLookup", "true").load(directory)
    if files.select("path").isEmpty():
        raise ValueError(f"no arrow files in {directory}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                raw = content.as_buffer()
                try:
                    reader = pa.ipc.open_stream(raw)
                    parts: Iterator = iter(reader)
                    names = reader.schema.names
                except pa.ArrowInvalid:
                    file = pa.ipc.open_file(raw)
                    parts, names = (file.get_batch(i) for i in range(file.num_record_batches)), file.schema.names
                key = next((c for c in ("id", "title") if c in names), None)
                for p in parts:
                    ids = p.column(key).cast(pa.string()) if key else pa.nulls(p.num_rows, pa.string())
                    out = pa.RecordBatch.from_arrays([ids, p.column("text").cast(pa.string())], names=["id", "text"])
                    yield out.filter(pc.fill_null(pc.greater(pc.utf8_length(out.column("text")), 0), False))

    return files.select("content").mapInArrow(rows, "id string, text string")


def read_documents(spark: SparkSession, source: str, catalog: Mapping[str, str] | None = None) -> DataFrame:
    path = resolve(source, catalog)
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("jsonl", "json"):
        return read_jsonl(spark, path)
    if kind == "txt":
        return read_text(spark, path)
    if kind == "arrow":
        return read_arrow_files(spark, str(Path(path).parent))
    if Path(path).is_dir() and any(Path(path).rglob("*.arrow")):
        return read_arrow_files(spark, path)
    return spark.read.parquet(path)


def read_first_of(spark: SparkSession, sources: list[str], catalog: Mapping[str, str] | None = None) -> DataFrame:
    """The first source that can be read; the last error if none can."""
    error: Exception = ValueError("no sources")
    for s in sources:
        try:
            return read_documents(spark, s, catalog)
        except Exception as e:  # noqa: BLE001
            error = e
    raise error


def read_mixed(spark: SparkSession, sources: list[dict], total: int, key: str = "id", version: str = "v1_6", catalog: Mapping[str, str] | None = None, seed: int = 42) -> DataFrame:
    """`total` rows of weighted sources ({name, subset, weight}); a source that cannot be read leaves
    the first one alone, as with any failing combination."""
    from millrace.operators.mixture import interleave, source_probabilities

    if version not in ("v1_6", "v1_7"):
        raise ValueError(f"unknown version {version}")
    p = source_probabilities(sources)
    frames = {s["name"]: read_documents(spark, s.get("path", s["name"]), catalog) for s in sources}
    return interleave(frames, dict(zip(frames, p)), total, key, seed)


def article_fields(df: DataFrame, title_prefix: bool = True) -> DataFrame:
    """(id, text): text or content, under its title with a blank line between; id, title, or a digest."""
    has = set(df.columns)
    text = F.coalesce(*[F.col(c) for c in ("text", "content") if c in has], F.lit(""))
    if "title" in has and title_prefix:
        text = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat(F.col("title"), F.lit("\n\n"), text)).otherwise(text)
    ids: list[Column] = [F.col(c).cast("string") for c in ("id", "title") if c in has]
    return df.select(F.coalesce(*ids, F.md5(text)).alias("id"), text.alias("text"))


def limit_kept(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in order, of rows that already passed their filters."""
    return df.orderBy(order).limit(n)


def seeded_order(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in an order fixed by the seed: what a shuffle buffer approximates."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
