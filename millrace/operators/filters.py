"""Filter cascades: features once, then one column with the first reason a row is rejected for.

Null texts are treated as empty ones. Reasons partition the rows: null means the row passes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrow import distinct_runs, top_shares
from millrace.functions.chars import SPACE, UPPER, WORD, count, ratio, strip, words


@dataclass(frozen=True)
class HeuristicLimits:
    min_chars: int = 100
    max_chars: int = 1_000_000
    min_lines: int = 3
    max_line_chars: int = 10_000
    max_run_repetition: float = 0.2
    max_line_repetition: float = 0.3
    max_special: float = 0.3
    min_alpha: float = 0.5
    min_word_chars: float = 2.0
    max_word_chars: float = 20.0
    balanced: bool = True


@dataclass(frozen=True)
class ExtraLimits:
    """Thresholds that the described configuration names without a definition; the definitions are ours."""

    min_chars: int = 200
    min_words: int = 50
    max_words: int = 100_000
    min_word_chars: float = 3.0
    max_word_chars: float = 10.0
    max_digits: float = 0.3
    max_upper: float = 0.3
    max_ellipses_per_100_words: float = 30.0
    max_bullets_per_100_words: float = 20.0
    min_stop_words: float = 0.1
    #: Frequent English words that count as stop words.
    stop_words: tuple[str, ...] = ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "with", "as", "was", "at", "by", "be", "this", "are", "or")


def balanced(c: Column) -> Column:
    """Whether (), [] and {} nest and the number of double quotes is even."""
    marks = F.split(F.regexp_replace(c, r"[^()\[\]{}]", ""), "")
    state = F.struct(F.lit("").alias("open"), F.lit(True).alias("ok"))

    def step(s: Column, m: Column) -> Column:
        top = F.right(s["open"], F.lit(1))
        fits = ((m == ")") & (top == "(")) | ((m == "]") & (top == "[")) | ((m == "}") & (top == "{"))
        opens = m.isin("(", "[", "{")
        grown = F.when(opens, F.concat(s["open"], m)).when(fits, F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)).otherwise(s["open"])
        return F.struct(grown.alias("open"), (s["ok"] & (opens | fits | (m == ""))).alias("ok"))

    nested = F.aggregate(marks, state, step, lambda s: s["ok"] & (s["open"] == ""))
    return nested & ((F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))) % 2 == 0)


def _numbers(text: Column) -> dict[str, Column]:
    """What the cascade compares. Counts of characters are lengths after dropping whole runs of the
    others, which is one match per run instead of one per character."""
    t = F.coalesce(text, F.lit(""))
    lines = F.split(t, "\n")
    n = F.length(t)
    left = lambda drop: F.length(F.regexp_replace(t, drop, ""))
    return {
        "chars": n,
        "lines": F.size(lines),
        "longest_line": F.array_max(F.transform(lines, F.length)),
        "full_lines": F.filter(F.transform(lines, strip), lambda l: l != ""),
        "runs": distinct_runs(t, 3),
        "alnum": left(r"[^\p{L}\p{N}]+"),
        "letters": left(r"\P{L}+"),
        "words": count(t, WORD + "+"),
        "word_letters": left(r"[^\p{L}\p{N}_]+"),
        "balanced": balanced(t),
    }


def _feature(name: Callable[[str], Column]) -> dict[str, Column]:
    n = name("chars")
    full = name("full_lines")
    return {
        "chars": n,
        "lines": name("lines"),
        "longest_line": name("longest_line"),
        "run_repetition": F.when(n > 2, F.lit(1.0) - name("runs") / (n - 2)).otherwise(0.0),
        "line_repetition": F.when(F.size(full) > 0, F.lit(1.0) - F.size(F.array_distinct(full)) / F.size(full)).otherwise(0.0),
        "special": F.when(n > 0, F.lit(1.0) - name("alnum") / n).otherwise(1.0),
        "alpha": ratio(name("letters").cast("double"), n),
        "words": name("words"),
        "word_chars": ratio(name("word_letters").cast("double"), name("words")),
        "balanced": name("balanced"),
    }


def heuristic_reason(f: Callable[[str], Column], limits: HeuristicLimits = HeuristicLimits()) -> Column:
    """The first failing check by the features f(name), or null."""
    reason = (
        F.when(~f("chars").between(limits.min_chars, limits.max_chars), "doc_length")
        .when((f("lines") < limits.min_lines) | (f("longest_line") > limits.max_line_chars), "line_filters")
        .when((f("run_repetition") > limits.max_run_repetition) | (f("line_repetition") > limits.max_line_repetition), "repetition")
        .when((f("special") > limits.max_special) | (f("alpha") < limits.min_alpha), "special_chars")
        .when((f("words") == 0) | ~f("word_chars").between(limits.min_word_chars, limits.max_word_chars), "word_stats")
    )
    return reason.when(~f("balanced"), "unbalanced") if limits.balanced else reason


def heuristic_filter(df: DataFrame, text: str = "text", limits: HeuristicLimits = HeuristicLimits()) -> DataFrame:
    """df with a struct `features` of the numbers and `reject_reason`, null for a row that passes.

    Struct and reason both read the plain columns below, so the optimiser keeps these as a step of
    their own; through the struct alone it would compute each number once per comparison.
    """
    rows = df.withColumns({f"_{k}": v for k, v in _numbers(F.col(text)).items()})
    f = _feature(lambda k: F.col(f"_{k}"))
    rows = rows.select(*df.columns, F.struct(*[v.alias(k) for k, v in f.items()]).alias("features"), heuristic_reason(f.__getitem__, limits).alias("reject_reason"))
    return rows


def heuristic_features(df: DataFrame, text: str = "text") -> DataFrame:
    return heuristic_filter(df, text).drop("reject_reason")


def extra_reason(c: Column, limits: ExtraLimits = ExtraLimits()) -> Column:
    t = F.coalesce(c, F.lit(""))
    w = words(t)
    n = F.size(w)
    hundred = n / 100.0
    stops = F.size(F.filter(F.transform(w, F.lower), lambda x: x.isin(*limits.stop_words)))
    bullets = count(t, r"(?m)^[\t ]*[-*•‣]")
    return (
        F.when(F.length(t) < limits.min_chars, "chars")
        .when(~n.between(limits.min_words, limits.max_words), "words")
        .when(~ratio(count(t, r"[^\t-\r\x1c-\x1f \x{85}\p{Z}]").cast("double"), n).between(limits.min_word_chars, limits.max_word_chars), "word_chars")
        .when(count(t, r"\p{Nd}") / F.length(t) > limits.max_digits, "digits")
        .when(count(t, UPPER) / F.length(t) > limits.max_upper, "upper")
        .when(count(t, r"\.\.\.|…") / hundred > limits.max_ellipses_per_100_words, "ellipses")
        .when(bullets / hundred > limits.max_bullets_per_100_words, "bullets")
        .when(stops / n < limits.min_stop_words, "stop_words")
    )


def reason_counts(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """(reason, n): rows by reason, `pass` for those without one."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


def filter_stats(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """One row: rows, rejected rows, and a map from reason to rows."""
    counts = reason_counts(df, reason)
    return counts.agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("reason") != "pass", F.col("n")).otherwise(0)).alias("rejected"),
        F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("reason_counts"),
    )


@dataclass(frozen=True)
class ArticleLimits:
    language: str = "en"
    confidence: float = 0.95
    min_words: int = 50
    max_words: int = 10_000
    min_word_chars: float = 3.0
    max_word_chars: float = 10.0
    min_quality: float = 0.7
    max_char_repetition: float = 0.2
    max_word_repetition: float = 0.2


#: The names of the limits in settings files.
ARTICLE_SETTINGS = {
    "target_language": "language", "min_language_confidence": "confidence", "min_article_length": "min_words", "max_article_length": "max_words",
    "min_avg_word_length": "min_word_chars", "max_avg_word_length": "max_word_chars", "min_quality_score": "min_quality",
    "max_char_repetition": "max_char_repetition", "max_word_repetition": "max_word_repetition",
}


def article_limits(settings: dict) -> tuple[ArticleLimits, dict]:
    """Limits from settings, flat or in sections, under their own or the file's names, and the settings that are none.
    Names that begin with _ are comments; a name given twice with different values is an error."""
    known = {f.name for f in fields(ArticleLimits)}
    found: dict = {}
    rest: dict = {}

    def read(part: dict, path: str) -> None:
        for name, value in part.items():
            if name.startswith("_"):
                continue
            field = ARTICLE_SETTINGS.get(name, name)
            if field in known and not isinstance(value, dict):
                if found.setdefault(field, value) != value:
                    raise ValueError(f"{field} is given twice")
            elif isinstance(value, dict):
                read(value, f"{path}{name}.")
            else:
                rest[path + name] = value

    read(settings, "")
    return ArticleLimits(**found), rest


def load_article_limits(path: str) -> tuple[ArticleLimits, dict]:
    """article_limits() of a JSON file."""
    return article_limits(json.loads(Path(path).read_text(encoding="utf-8")))


def word_count(t: Column) -> Column:
    return F.size(words(t))


def top_share(items: Column) -> Column:
    """Share of the most frequent item of an array of strings, 0 for an empty one.

    Sorted, equal items stand together; one pass keeps the length of the run and the longest so far.
    """
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    most = F.aggregate(F.array_sort(items), start, step, lambda s: s["most"])
    return ratio(most.cast("double"), F.size(items))


def article_reason(df: DataFrame, raw: str, cleaned: str, right_language: Column | None = None, duplicate: Column | None = None, limits: ArticleLimits = ArticleLimits(), safe: Column | None = None) -> DataFrame:
    """df with `reject_reason`, the first check an article fails, or null; the checks come in the order
    of the cascade. Numbers are plain columns below the reason, so each is computed once."""
    t = F.col(cleaned)
    sentences = F.filter(F.transform(F.split(t, r"[.!?]+"), strip), lambda s: s != "")
    length = lambda drop: F.length(F.regexp_replace(t, drop, ""))
    numbers = {
        "_raw_words": word_count(F.col(raw)),
        "_words": word_count(t),
        "_chars": F.length(t),
        "_visible": length(SPACE + "+"),
        "_sentences": F.transform(sentences, lambda s: F.size(words(s))),
        "_marks": length(r"[^.!?,;:]+"),
        "_upper": length(r"\P{Lu}+"),
        "_special": length("[a-zA-Z0-9\\t-\\r\\x1c-\\x1f \\x{85}\\p{Z}.!?,;:'\"-]+"),
        "_top": top_shares(F.lower(t)),
    }
    rows = df.withColumns(numbers)
    n, chars, s = F.col("_words"), F.col("_chars"), F.col("_sentences")
    per_sentence = ratio(F.aggregate(s, F.lit(0), lambda a, b: a + b).cast("double"), F.size(s))
    off = lambda c, lo, hi, by: F.when((c < lo) | (c > hi), F.lit(by)).otherwise(F.lit(1.0))
    quality = F.when(F.size(s) > 0, off(per_sentence, 5, 50, 0.8)).otherwise(1.0)
    quality = quality * F.when(n > 0, off(F.try_divide("_marks", "_words"), 0.05, 0.3, 0.9)).otherwise(1.0)
    quality = quality * off(F.try_divide("_upper", "_chars"), 0.01, 0.1, 0.9) * F.when(F.try_divide("_special", "_chars") > 0.1, 0.8).otherwise(1.0)
    mean = ratio(F.col("_visible").cast("double"), n)
    out = (
        F.when((F.col("_raw_words") < limits.min_words) | (F.col("_raw_words") > limits.max_words * 1.5), "invalid_length")
        .when(F.coalesce(chars, F.lit(0)) < 50, "empty_after_cleaning")
        .when(~n.between(limits.min_words, limits.max_words) | ~mean.between(limits.min_word_chars, limits.max_word_chars), "invalid_length")
    )
    if right_language is not None:
        out = out.when(~F.coalesce(right_language, F.lit(False)), "wrong_language")
    out = out.when(quality < limits.min_quality, "low_quality")
    out = out.when((F.col("_top")["letters"] > limits.max_char_repetition) | (F.col("_top")["words"] > limits.max_word_repetition), "too_repetitive")
    if duplicate is not None:
        out = out.when(duplicate, "duplicate")
    if safe is not None:  # a check of one's own; there is none by default
        out = out.when(~F.coalesce(safe, F.lit(True)), "unsafe_content")
    return rows.select(*df.columns, out.alias("reject_reason"))
