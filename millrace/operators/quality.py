"""Quality scores: heuristic, trained classifier, n-gram perplexity and their ensemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.chars import let, ratio, words


def heuristic_score(c: Column) -> Column:
    """Product of penalties, between 0 and 1; 0 for a null or empty text.

    The numbers are bound once; character counts are lengths after dropping whole runs of the others.
    """

    def score(t: Column, w: Column) -> Column:
        n, alpha = F.length(t), F.length(F.regexp_replace(t, r"\P{L}+", ""))
        upper = F.length(F.regexp_replace(t, r"\P{Lu}+", ""))

        def product(x: Column) -> Column:
            out = F.when(n < 100, 0.5).when(n < 200, 0.8).otherwise(1.0)
            out = out * F.when(x["words"] < 50, 0.6).otherwise(1.0)
            out = out * F.when((x["words"] > 0) & (x["different"] / x["words"] < 0.3), 0.5).otherwise(1.0)
            out = out * F.when(ratio(x["alpha"].cast("double"), n) < 0.5, 0.7).otherwise(1.0)
            out = out * F.when(ratio(x["upper"].cast("double"), x["alpha"]) > 0.3, 0.8).otherwise(1.0)
            return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), out)))

        return let(F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("different"), alpha.alias("alpha"), upper.alias("upper")), product)

    t = F.coalesce(c, F.lit(""))
    return let(words(t), lambda w: score(t, w))


def train_classifier(labelled: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16, max_rows: int | None = None, seed: int = 42):
    """Logistic regression over hashed words and word pairs; label 1 is good.

    With max_rows the model is fitted on that many rows, chosen by hash; scoring covers every row.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler

    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("double").alias("label")).where("label IS NOT NULL")
    if max_rows is not None:
        rows = rows.orderBy(F.xxhash64("text", F.lit(seed))).limit(max_rows)
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[\p{L}\p{N}_]+", gaps=False),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(inputCol="words", outputCol="tf1", numFeatures=features),
        HashingTF(inputCol="pairs", outputCol="tf2", numFeatures=features),
        VectorAssembler(inputCols=["tf1", "tf2"], outputCol="features"),
        LogisticRegression(maxIter=25, regParam=0.01),
    ]).fit(rows)


def classifier_score(df: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df.withColumn("text", F.coalesce(F.col(text), F.lit(""))))
    return scored.select(*[F.col(c) for c in df.columns], F.round(vector_to_array("probability")[1], 6).alias(out))


def pair_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(first, second, pair_n, first_n): counts of word pairs, a text beginning with ''. Nothing is sampled."""
    w = F.concat(F.array(F.lit("")), words(F.lower(F.col(text))))
    pairs = df.where(F.col(text).isNotNull()).select(F.explode(F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("first"), F.slice(w, F.lit(2), F.size(w) - 1).alias("second"))).alias("p"))
    counts = pairs.groupBy(F.col("p.first").alias("first"), F.col("p.second").alias("second")).agg(F.count("*").alias("pair_n"))
    first = counts.groupBy("first").agg(F.sum("pair_n").alias("first_n"))
    return counts.join(first, "first")


def perplexity(df: DataFrame, model: DataFrame, key: str, text: str = "text", empty: float = 500.0) -> DataFrame:
    """(key, perplexity): 10 to the mean negative log10 probability of a word, add-one smoothed pairs.

    A text without words gets `empty`. Texts meet the model by an equi-join on the pair.
    """
    vocabulary = model.select("second").distinct().count() + 1
    w = F.concat(F.array(F.lit("")), words(F.lower(F.coalesce(F.col(text), F.lit("")))))
    pairs = df.select(F.col(key), F.explode(F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("first"), F.slice(w, F.lit(2), F.size(w) - 1).alias("second"))).alias("p"))
    pairs = pairs.groupBy(key, F.col("p.first").alias("first"), F.col("p.second").alias("second")).agg(F.count("*").alias("n"))
    firsts = model.select("first", "first_n").distinct()
    seen = pairs.join(model.select("first", "second", "pair_n"), ["first", "second"], "left").join(firsts, "first", "left")
    p = (F.coalesce("pair_n", F.lit(0)) + 1) / (F.coalesce("first_n", F.lit(0)) + F.lit(vocabulary))
    out = seen.groupBy(key).agg((F.sum(F.col("n") * F.log10(p)) / F.sum("n")).alias("mean"))
    return df.select(key).join(out, key, "left").select(key, F.coalesce(F.pow(F.lit(10.0), -F.col("mean")), F.lit(empty)).alias("perplexity"))


def perplexity_score(p: Column, most: float = 1000.0) -> Column:
    """1 - p/most, 0 from most on."""
    return F.when(p >= most, 0.0).otherwise(1.0 - p / most)


def ensemble(classifier: Column | None = None, perplexity: Column | None = None, weights: tuple[float, float] = (0.6, 0.4)) -> Column:
    """Linear combination of the scores that are given, their weights normalised."""
    given = [(s, w) for s, w in ((classifier, weights[0]), (perplexity, weights[1])) if s is not None]
    if not given or not sum(w for _, w in given):
        raise ValueError("an ensemble needs at least one score with a weight")
    total = sum(w for _, w in given)
    out = F.lit(0.0)
    for s, w in given:
        out = out + s * F.lit(w / total)
    return out
