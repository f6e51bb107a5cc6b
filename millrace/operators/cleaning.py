"""Row transforms that clean text. A null text stays null, an empty one empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrow import tidied
from millrace.functions.chars import SPACE, ratio, strip

CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"


def drop_controls(c: Column | str) -> Column:
    """Without control characters; tab, line feed and carriage return stay."""
    return F.regexp_replace(c, CONTROLS, "")


def collapse_blanks(c: Column | str, keep_lines: bool = False) -> Column:
    """Every run of blanks becomes one space; with keep_lines only within lines, and at most one empty line."""
    if not keep_lines:
        return F.trim(F.regexp_replace(c, SPACE + "+", " "))
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\t\x0b\x0c\x1c-\x1f \x{85}\p{Z}]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean(c: Column | str, form: str | None = "NFKC", mojibake: bool = True, unescape: bool = True, controls: bool = True, blanks: bool = True, compat: bool = False) -> Column:
    """The whole cascade. compat collapses line breaks too, as the described pipeline does, after
    which no text has three lines; by default lines are kept."""
    out = tidied(c, form, mojibake, unescape) if form or mojibake or unescape else F.col(c) if isinstance(c, str) else c
    out = drop_controls(out) if controls else out
    return collapse_blanks(out, keep_lines=not compat) if blanks else out


def cleaning_stats(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: documents, characters before and after, removed characters and their share."""
    removed = F.greatest(F.length(before) - F.length(after), F.lit(0))
    one = df.agg(F.count(before).alias("documents"), F.sum(F.length(before)).alias("chars_before"), F.sum(F.length(after)).alias("chars_after"), F.sum(removed).alias("chars_removed"))
    return one.withColumn("removed_share", ratio(F.col("chars_removed").cast("double"), F.col("chars_before")))


def strip_markup(c: Column | str) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


#: Markup of encyclopedia articles that carries no text, in order.
BOILERPLATE = (
    r"\[\[Category:.*?\]\]",
    r"\{\{.*?\}\}",
    r"<ref.*?>.*?</ref>",
    r"<references.*?/>",
    r"\|\s*[a-z_]+\s*=",
    r"File:.*?\|",
    r"thumb\|",
    r"\{\{cite.*?\}\}",
    r"\{\{Citation.*?\}\}",
    r"==\s*References\s*==.*",
    r"==\s*External links\s*==.*",
    r"==\s*See also\s*==.*",
)
#: The sections of an article that hold no text of its own.
SECTIONS = ("References", "Bibliography", "Sources")


def strip_boilerplate(c: Column | str) -> Column:
    c = F.regexp_replace(c, "(?is)" + "|".join(BOILERPLATE), "")
    for s in SECTIONS:
        c = F.regexp_replace(c, rf"(?is)==\s*{s}\s*==.*", "")
    return c


def clean_article(c: Column | str, boilerplate: bool = True, references: bool = True) -> Column:
    """Tags, boilerplate, reference sections, blanks, then the normal form (not stripped again)."""
    c = strip_markup(c)
    if boilerplate:
        c = F.regexp_replace(c, "(?is)" + "|".join(BOILERPLATE), "")
    if references:
        for s in SECTIONS:
            c = F.regexp_replace(c, rf"(?is)==\s*{s}\s*==.*", "")
    return tidied(collapse_blanks(c), "NFKC", mojibake=False, unescape=False)
