"""Table-shaped metrics: router loads, step timing, preference and reward statistics, similarities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrow import matcher_ratio
from millrace.functions.chars import words


def all_groups(counts: DataFrame, key: str, number: int, value: str = "n") -> DataFrame:
    """counts with a row of 0 for each group 0..number-1 that has none."""
    every = counts.sparkSession.range(number).select(F.col("id").cast("int").alias(key))
    return every.join(counts, key, "left").fillna({value: 0})


def load_metrics(df: DataFrame, expert: str, experts: int) -> DataFrame:
    """One row: tokens, used experts, entropy, utilisation, coefficient of variation, least and largest load."""
    n = all_groups(df.groupBy(F.col(expert).cast("int").alias("expert")).agg(F.count("*").alias("n")), "expert", experts)
    total = n.agg(F.sum("n").alias("total"))
    p = n.join(total.withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).withColumn("p", F.try_divide("n", "total"))
    return p.agg(
        F.sum("n").alias("tokens"),
        F.count_if(F.col("n") > 0).alias("used"),
        F.sum(F.when(F.col("n") > 0, -F.col("p") * F.log(F.col("p") + 1e-8))).alias("entropy"),
        (F.count_if(F.col("n") > 0) / F.lit(experts)).alias("utilisation"),
        (F.stddev_samp("n") / (F.avg("n") + 1e-8)).alias("imbalance"),
        F.min("p").alias("min_load"),
        F.max("p").alias("max_load"),
    )


def expert_frequency(df: DataFrame, expert: str, experts: int) -> DataFrame:
    """(expert, n, frequency), experts without tokens included."""
    n = all_groups(df.groupBy(F.col(expert).cast("int").alias("expert")).agg(F.count("*").alias("n")), "expert", experts)
    return n.withColumn("frequency", F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))  # one row per expert


def load_window(counts: DataFrame, step: str, expert: str, count: str, experts: int, window: int = 100) -> DataFrame:
    """(step, expert, load, mean, std, min, max, under, over) over the last `window` steps of each expert."""
    share = F.col(count) / (F.sum(count).over(Window.partitionBy(step)) + 1e-8)
    rows = counts.select(step, expert, share.alias("load"))
    last = Window.partitionBy(expert).orderBy(step).rowsBetween(1 - window, 0)
    out = rows.select(step, expert, "load", *[f("load").over(last).alias(name) for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))])
    return out.withColumn("under", F.col("mean") < 0.5 / experts).withColumn("over", F.col("mean") > 2.0 / experts)


def step_timing(df: DataFrame, series: str, step: str, seconds: str, tokens: str, window: int = 100) -> DataFrame:
    """Per series: trailing mean of the step time, tokens per second over it, running token total."""
    order = Window.partitionBy(series).orderBy(step)
    mean = F.avg(seconds).over(order.rowsBetween(1 - window, 0))
    return df.select(series, step, mean.alias("mean_seconds"), F.try_divide(F.avg(tokens).over(order.rowsBetween(1 - window, 0)), mean).alias("tokens_per_second"), F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("tokens_so_far"))


def ordered_fold(df: DataFrame, key: str, order: str, value: str, start: Column, step: Callable[[Column, Column], Column], out: str = "state") -> DataFrame:
    """(key, out): fold of the values of a key in order; a series is one row, as its length is bounded by its steps."""
    series = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).alias("x"))))
    return df.groupBy(key).agg(F.aggregate(series, start, lambda s, r: step(s, r["x"])).alias(out))


def ema_load(loads: DataFrame, expert: str, step: str, load: str, experts: int, decay: float = 0.99, gamma: float = 0.001) -> DataFrame:
    """(expert, ema, bias) after all steps: smoothed load, and a bias moved by -gamma times the sign of its
    distance from the even load at each step, kept between -2 and 2."""
    start = F.struct(F.lit(0.0).alias("ema"), F.lit(0.0).alias("bias"))

    def one(s: Column, x: Column) -> Column:
        ema = s["ema"] * decay + x * (1 - decay)
        moved = s["bias"] - F.signum(ema - 1.0 / experts) * gamma
        return F.struct(ema.alias("ema"), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), moved)).alias("bias"))

    return ordered_fold(loads, expert, step, load, start, one).select(expert, "state.ema", "state.bias")


def ema(df: DataFrame, key: str, order: str, value: str, decay: float = 0.99) -> DataFrame:
    """(key, ema): exponential mean that begins with the first value."""
    start = F.lit(None).cast("double")
    return ordered_fold(df, key, order, value, start, lambda s, x: F.when(s.isNull(), x).otherwise(s * decay + x * (1 - decay)), "ema")


def balance_loss(df: DataFrame, expert: str, probability: str, experts: int, weight: float = 1.0, form: str = "choices", per_token: int = 1) -> DataFrame:
    """One row: weight * experts * sum over experts of usage times mean routing probability.

    Rows are (token, expert, probability, chosen) for every expert of a token. The usage of an expert is
    its share of all choices (form choices), its choices by the number of tokens (tokens), or the latter
    by per_token, the number of choices a token has (sequence).
    """
    if form not in ("choices", "tokens", "sequence"):
        raise ValueError(f"unknown form {form}")
    per = df.groupBy(expert).agg(F.sum(F.col("chosen").cast("double")).alias("c"), F.avg(probability).alias("p"), F.count("*").alias("tokens"))
    total = F.sum("c").over(Window.partitionBy(F.lit(1)))  # one row per expert
    usage = F.try_divide("c", total) if form == "choices" else F.try_divide("c", F.col("tokens"))
    scale = weight * experts / (per_token if form == "sequence" else 1)
    return per.withColumn("f", usage).agg((F.sum(F.col("f") * F.col("p")) * scale).alias("balance_loss"))


def capacity_metrics(df: DataFrame, step: str, expert: str, experts: int, capacity: int) -> DataFrame:
    """(step, tokens, overflow, capacity_used): choices beyond an expert's capacity, and what the others fill of all capacity."""
    n = df.groupBy(step, expert).agg(F.count("*").alias("n"))
    per = n.groupBy(step).agg(F.sum("n").alias("tokens"), F.sum(F.greatest(F.col("n") - capacity, F.lit(0))).alias("overflow"))
    used = (F.col("tokens") - F.col("overflow")) / F.lit(capacity * experts) if capacity * experts > 0 else F.lit(0.0)
    return per.withColumn("capacity_used", used.cast("double"))


def expert_balance(df: DataFrame, expert: str, experts: int, weights: str) -> DataFrame:
    """One row: balance (deviation by mean of the experts' choices), least and largest load, and the mean
    of the largest weight of a token; rows are tokens with an array of experts and one of weights."""
    chosen = df.select(F.explode(expert).alias("expert")).select(F.col("expert").cast("int"))
    n = all_groups(chosen.groupBy("expert").agg(F.count("*").alias("n")), "expert", experts)
    loads = n.agg((F.stddev_samp("n") / (F.avg("n") + 1e-6)).alias("balance"), (F.min("n") / F.sum("n")).alias("min_load"), (F.max("n") / F.sum("n")).alias("max_load"))
    sure = df.agg(F.avg(F.array_max(weights)).alias("router_confidence"))
    return loads.withColumn("one", F.lit(1)).join(sure.withColumn("one", F.lit(1)), "one").drop("one")  # one row each


def average_metrics(df: DataFrame, key: str, value: str, skip: tuple[str, ...] = ("count",)) -> DataFrame:
    """(key, mean) of the values that are numbers; keys in skip are left out."""
    number = F.col(value).try_cast("double")
    return df.where(~F.col(key).isin(*skip)).groupBy(key).agg(F.avg(number).alias("mean"))


def preference_metrics(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """One row: accuracy (strictly larger), means, margin and mean logistic loss of rewards."""
    d = F.col(chosen) - F.col(rejected)
    return df.agg(
        F.avg((F.col(chosen) > F.col(rejected)).cast("double")).alias("accuracy"),
        F.avg(chosen).alias("chosen_reward"),
        F.avg(rejected).alias("rejected_reward"),
        F.avg(d).alias("margin"),
        F.avg(F.when(d > 0, F.log1p(F.exp(-d))).otherwise(-d + F.log1p(F.exp(d)))).alias("loss"),
    )


def gae(rewards: Column, values: Column, masks: Column | None = None, gamma: float = 0.99, lam: float = 0.95, bootstrap: bool = False) -> Column:
    """Advantages by a fold from the end. bootstrap=False: the last place has advantage 0 and the one
    before it no next value; True: every place counts, with value 0 after the last."""
    n = F.size(rewards)
    masks = masks if masks is not None else F.array_repeat(F.lit(1.0), n)
    last = n if bootstrap else n - 1
    places = F.when(last >= 1, F.reverse(F.sequence(F.lit(1), F.greatest(last, F.lit(1))))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0.0).alias("gae"), (F.array().cast("array<double>") if bootstrap else F.slice(F.array(F.lit(0.0)), F.lit(1), F.least(n, F.lit(1)))).alias("out"))

    def step(s: Column, t: Column) -> Column:
        following = F.when(t == last, F.lit(0.0)).otherwise(F.coalesce(F.try_element_at(values, t + 1), F.lit(0.0)))
        delta = F.element_at(rewards, t) + gamma * following - F.element_at(values, t)
        g = delta + gamma * lam * s["gae"] * F.coalesce(F.try_element_at(masks, t + 1), F.lit(0.0))
        return F.struct(g.alias("gae"), F.concat(F.array(g), s["out"]).alias("out"))

    return F.aggregate(places, start, step, lambda s: s["out"])


def token_kl(log_p: Column, log_q: Column, mask: Column) -> Column:
    """Sum over the places with mask of log p - log q."""
    d = F.zip_with(F.zip_with(log_p, log_q, lambda a, b: a - b), mask, lambda x, m: x * m)
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def accepted_prefix(draws: Column, p: Column, q: Column) -> Column:
    """How many drafts are accepted: while u < min(1, p/q), up to the first rejection."""
    ok = F.zip_with(draws, F.zip_with(p, q, lambda a, b: F.least(F.lit(1.0), a / b)), lambda u, r: u < r)
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    return F.aggregate(ok, start, lambda s, o: F.struct((s["n"] + (s["open"] & o).cast("int")).alias("n"), (s["open"] & o).alias("open")), lambda s: s["n"])


def speculation_depth(df: DataFrame, series: str, step: str, accepted: str, proposed: str, start: int = 1, longest: int = 4, window: int = 10) -> DataFrame:
    """(series, depth): after each step the mean acceptance of the last `window` steps moves the depth by one."""
    rate = F.coalesce(F.try_divide(F.col(accepted).cast("double"), F.col(proposed)), F.lit(0.0))
    mean = F.avg(rate).over(Window.partitionBy(series).orderBy(step).rowsBetween(1 - window, 0))
    rows = df.select(series, step, mean.alias("mean"))
    move = lambda d, m: F.when(m > 0.8, F.least(d + 1, F.lit(longest))).when(m < 0.5, F.greatest(d - 1, F.lit(1))).otherwise(d)
    return ordered_fold(rows, series, step, "mean", F.lit(start), move, "depth")


def entropy(probabilities: Column) -> Column:
    return F.aggregate(F.transform(probabilities, lambda p: -p * F.log(p + 1e-10)), F.lit(0.0), lambda s, x: s + x)


def distinct_ratio(values: Column) -> Column:
    return F.try_divide(F.size(F.array_distinct(values)).cast("double"), F.size(values))


def victims(df: DataFrame, cache: str, key: str, hits: str, last_used: str, now: float, policy: str = "lru") -> DataFrame:
    """(cache, key) to evict next: least recently, least frequently, or least often by age; ties by key."""
    score = {"lru": F.col(last_used), "lfu": F.col(hits), "adaptive": F.col(hits) / (F.lit(now) - F.col(last_used) + 1)}.get(policy)
    if score is None:
        raise ValueError(f"unknown policy {policy}")
    return df.groupBy(cache).agg(F.min_by(F.col(key), F.struct(score, F.col(key))).alias(key))


def hit_rate(df: DataFrame, cache: str, hit: str) -> DataFrame:
    return df.groupBy(cache).agg(F.count_if(F.col(hit)).alias("hits"), F.count_if(~F.col(hit)).alias("misses"), F.avg(F.col(hit).cast("double")).alias("hit_rate"))


def mean_perplexity(df: DataFrame, loss: str) -> DataFrame:
    return df.agg(F.avg(loss).alias("loss"), F.exp(F.avg(loss)).alias("perplexity"))


def position_similarity(a: Column, b: Column) -> Column:
    """Percent of places with equal characters, of the longer text; 0 if one is null or empty."""
    n = F.least(F.length(a), F.length(b))
    x, y = F.slice(F.split(a, ""), F.lit(1), n), F.slice(F.split(b, ""), F.lit(1), n)
    same = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when((F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0), 0.0).otherwise(same * 100.0 / F.greatest(F.length(a), F.length(b)))


def word_recall(expected: Column, generated: Column) -> Column:
    e = F.array_distinct(words(F.lower(expected)))
    return F.when(F.size(e) > 0, F.size(F.array_intersect(e, F.array_distinct(words(F.lower(generated))))) * 100.0 / F.size(e)).otherwise(0.0)


def combined_similarity(expected: Column, generated: Column) -> Column:
    """0.5 * contained + 0.3 * matching blocks + 0.2 * word recall, in percent; 0 if one is null or empty."""
    e, g = F.lower(expected), F.lower(generated)
    score = F.when(F.contains(g, e), 100.0).otherwise(0.0) * 0.5 + matcher_ratio(e, g) * 100.0 * 0.3 + word_recall(expected, generated) * 0.2
    return F.when((F.coalesce(F.length(expected), F.lit(0)) == 0) | (F.coalesce(F.length(generated), F.lit(0)) == 0), 0.0).otherwise(score)


def pattern_hits(c: Column, patterns: list[str]) -> Column:
    """The patterns (plain, case ignored) that a text contains."""
    return F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(p)))


def tokens_for(parameters: int | Column, ratio: float = 20.0):
    return (parameters * ratio).cast("long") if isinstance(parameters, Column) else int(parameters * ratio)


def training_band(tokens: Column, parameters: Column, low: float = 20.0, high: float = 26.0, slack: float = 0.01) -> Column:
    r = tokens / parameters
    return F.when(r < low - slack, "under").when(r > high + slack, "over").otherwise("optimal")


def compression(df: DataFrame, series: str, step: str, raw: str, packed: str, window: int = 100) -> DataFrame:
    """Ratio and bytes saved per step, and the mean ratio of the last `window` steps."""
    r = F.try_divide(F.col(raw).cast("double"), F.col(packed))
    last = Window.partitionBy(series).orderBy(step).rowsBetween(1 - window, 0)
    return df.select(series, step, r.alias("ratio"), (F.col(raw) - F.col(packed)).alias("saved"), F.avg(r).over(last).alias("mean_ratio"))


def best_matches(df: DataFrame, minima: dict[str, float], by: str, key: str, n: int = 3) -> DataFrame:
    """The n rows with the largest `by` among those that reach all minima; ties by key."""
    for c, least in minima.items():
        df = df.where(F.col(c) >= least)
    return df.orderBy(F.col(by).desc(), key).limit(n)


def retained(df: DataFrame, group: str, time: str, key: str, keep: int) -> DataFrame:
    """df with `keep` (among the newest of its group) and `latest`; ties by key."""
    newest = F.row_number().over(Window.partitionBy(group).orderBy(F.col(time).desc(), F.col(key).desc()))
    return df.withColumn("_r", newest).withColumn("keep", F.col("_r") <= keep).withColumn("latest", F.col("_r") == 1).drop("_r")
