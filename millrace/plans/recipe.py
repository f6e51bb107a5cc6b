"""The corpus pipeline: clean, deduplicate, filter, score, mix; each stage a lazy DataFrame."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.cleaning import clean
from millrace.operators.dedup import near_dedup
from millrace.operators.domains import classify
from millrace.operators.filters import HeuristicLimits, heuristic_filter
from millrace.operators.mixture import documents_for_tokens, mix, resolve_weights
from millrace.operators.quality import classifier_score, ensemble, heuristic_score, perplexity, perplexity_score
from millrace.sources.readers import read_documents
from millrace.sources.sinks import FORMATS, snapshot, write_documents, write_stats
from millrace.streaming.dedup import NearDedupSink, exact_stream, near_stream


@dataclass
class Recipe:
    """What the pipeline does; the defaults clean, deduplicate and filter."""

    clean: bool = True
    compat: bool = False
    dedup: bool = True
    dedup_method: str = "minhash"
    threshold: float = 0.8
    n_gram: int = 13
    heuristics: bool = True
    limits: dict = field(default_factory=dict)
    quality: bool = False
    classifier: bool = True
    perplexity: bool = False
    min_quality: float = 0.5
    max_perplexity: float = 1000.0
    quality_weights: tuple[float, float] = (0.6, 0.4)
    allow_fallback: bool = False
    mixing: bool = False
    composition: str | dict = "default"
    domain_method: str = "hybrid"
    target_documents: int | None = None
    target_tokens: int | None = None
    seed: int = 42
    output_format: str = "jsonl"
    snapshots: str | None = None

    def check(self, streaming: bool = False) -> None:
        if self.output_format not in FORMATS:
            raise ValueError(f"unknown format {self.output_format}")
        if self.mixing and streaming:
            raise ValueError("mixing needs the whole corpus and cannot be streamed")
        if self.quality and not (self.classifier or self.perplexity):
            raise ValueError("the quality stage needs the classifier, perplexity or both")
        if self.mixing:
            resolve_weights(self.composition)
        HeuristicLimits(**self.limits)

    @classmethod
    def load(cls, path: str) -> Recipe:
        import yaml

        data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        unknown = set(data) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**data)

    def save(self, path: str) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(asdict(self), sort_keys=False, allow_unicode=True), encoding="utf-8")


@dataclass
class Models:
    """What the quality stage scores with: a fitted classifier and a table of pair counts."""

    classifier: PipelineModel | None = None
    pairs: DataFrame | None = None


def quality_stage(df: DataFrame, recipe: Recipe, key: str, text: str, models: Models | None = None) -> DataFrame:
    """The rows that pass the quality filter: both scores as an ensemble, else the one that is on by its own limit.

    A score without its model is an error unless the recipe allows the fallback: the heuristic score for
    the classifier, half of the largest perplexity for perplexity.
    """
    models = models or Models()
    for name, on, model in (("classifier", recipe.classifier, models.classifier), ("perplexity", recipe.perplexity, models.pairs)):
        if on and model is None and not recipe.allow_fallback:
            raise ValueError(f"the {name} has no model; give one or set allow_fallback")
    columns, scored = df.columns, df
    if recipe.classifier:
        scored = classifier_score(scored, models.classifier, text, "_good") if models.classifier is not None else scored.withColumn("_good", heuristic_score(F.col(text)))
    if recipe.perplexity:
        if models.pairs is not None:
            scored = scored.join(perplexity(df, models.pairs, key, text, recipe.max_perplexity / 2).withColumnRenamed("perplexity", "_ppl"), key)
        else:
            scored = scored.withColumn("_ppl", F.lit(recipe.max_perplexity / 2))
    good, fluent = F.col("_good"), F.col("_ppl")
    if recipe.classifier and recipe.perplexity:
        passed = ensemble(good, perplexity_score(fluent, recipe.max_perplexity), tuple(recipe.quality_weights)) >= recipe.min_quality
    elif recipe.classifier:
        passed = good >= recipe.min_quality
    else:
        passed = fluent <= recipe.max_perplexity
    return scored.where(passed).select(*columns)


def run(df: DataFrame, recipe: Recipe, key: str = "id", order: str | None = None, text: str = "text", label: str | None = None, models: Models | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The resulting rows and the rows after each stage, by name. All columns of df are carried along."""
    recipe.check(df.isStreaming)
    if df.isStreaming:
        raise ValueError("a stream is run by run_stream")
    stages = {"input": df}
    if recipe.clean:
        df = stages["cleaned"] = snapshot(df.withColumn(text, clean(F.col(text), compat=recipe.compat)).where(F.length(text) > 0), recipe.snapshots, "01_cleaned")
    if recipe.dedup:
        df = stages["deduplicated"] = snapshot(near_dedup(df, recipe.dedup_method, key, order or key, text, recipe.n_gram, recipe.threshold), recipe.snapshots, "02_deduplicated")
    if recipe.heuristics:
        df = stages["heuristic"] = snapshot(heuristic_filter(df, text, HeuristicLimits(**recipe.limits)).where("reject_reason IS NULL").drop("features", "reject_reason"), recipe.snapshots, "03_heuristic")
    if recipe.quality:
        df = stages["quality"] = snapshot(quality_stage(df, recipe, key, text, models), recipe.snapshots, "04_quality")
    if recipe.mixing:
        rows = classify(df, text, label, recipe.domain_method)
        total = recipe.target_documents or (documents_for_tokens(recipe.target_tokens) if recipe.target_tokens else rows.count())
        df = stages["mixed"] = snapshot(mix(rows, recipe.composition, total, key, "domain_found", recipe.seed).drop("place", "copies"), recipe.snapshots, "05_mixed")
    return df, stages


def run_stream(df: DataFrame, recipe: Recipe, output: str, state: str, key: str = "id", order: str | None = None, text: str = "text"):
    """The recipe's stages on a stream, its rows appended as JSON lines below output; the query, which
    goes on where it stopped when started again with the same state folder. The quality stage needs no
    state, but a model that is a table, so only the classifier's fallback is there for streams."""
    recipe.check(True)
    if recipe.quality and (recipe.perplexity or not recipe.allow_fallback):
        raise ValueError("streams score quality by the heuristic score only; set allow_fallback")
    if recipe.clean:
        df = df.withColumn(text, clean(F.col(text), compat=recipe.compat)).where(F.length(text) > 0)
    passed = lambda rows: heuristic_filter(rows, text, HeuristicLimits(**recipe.limits)).where("reject_reason IS NULL").drop("features", "reject_reason")
    near = recipe.dedup and recipe.dedup_method != "exact_hash"
    if recipe.dedup and not near:
        df = exact_stream(df, text)
    if recipe.heuristics and not near:
        df = passed(df)
    if recipe.quality and not near:
        df = df.where(heuristic_score(F.col(text)) >= recipe.min_quality)
    if not near:
        return df.writeStream.format("json").option("path", output).option("checkpointLocation", f"{state}/query").option("ignoreNullFields", "false").trigger(availableNow=True).start()

    def later(rows: DataFrame) -> DataFrame:
        rows = passed(rows) if recipe.heuristics else rows
        return rows.where(heuristic_score(F.col(text)) >= recipe.min_quality) if recipe.quality else rows

    sink = NearDedupSink(f"{state}/kept", key, order or key, text, recipe.n_gram, recipe.threshold, jsonl=output, later=later)
    return near_stream(df, sink, f"{state}/query")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, place, rows) of the stages of a run."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("stage"), F.lit(i).alias("place"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def process(spark: SparkSession, source: str, output: str, recipe: Recipe, key: str = "id") -> dict:
    """Read, run, write, and leave pipeline_stats.json beside the output.

    Stages are written below the output (or where the recipe says) so that each is computed once.
    """
    if recipe.snapshots is None:
        recipe = replace(recipe, snapshots=f"{output}/stages")
    result, stages = run(read_documents(spark, source), recipe, key)
    write_documents(result, f"{output}/documents", recipe.output_format)
    stats = {r["stage"]: r["rows"] for r in stage_counts(stages).collect()}  # one row per stage
    return write_stats(stats, f"{output}/pipeline_stats.json", spark)


def main(argv: list[str] | None = None) -> int:
    import argparse

    p = argparse.ArgumentParser(description="Prepare a corpus")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--recipe")
    p.add_argument("--format", choices=FORMATS)
    p.add_argument("--dedup-method")
    p.add_argument("--threshold", type=float)
    for stage in ("clean", "dedup", "heuristics", "quality"):
        p.add_argument(f"--no-{stage}", action="store_true")
    a = p.parse_args(argv)
    recipe = Recipe.load(a.recipe) if a.recipe else Recipe()
    for name, value in (("output_format", a.format), ("dedup_method", a.dedup_method), ("threshold", a.threshold)):
        if value is not None:
            setattr(recipe, name, value)
    for stage in ("clean", "dedup", "heuristics", "quality"):
        if getattr(a, f"no_{stage}"):
            setattr(recipe, stage, False)
    print(process(SparkSession.builder.appName("millrace").getOrCreate(), a.input, a.output, recipe))
    return 0
