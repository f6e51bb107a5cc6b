"""Problem 5: statistics of each text, and whether it is natural prose, a list, a table or junk.

A text is first brought to its consistent form (so that look-alike letters and invisible characters
do not hide its words) and cut into lines. Tables show by vertical alignment of delimiters: runs of
lines with the same number of the same delimiter, the same sequence of punctuation, or columns of
blanks at the same places. Lists show by markers, the delimiters of their first column, or by the
autocorrelation of line lengths: the lengths of neighbouring items, or of those a few lines apart where
an item has several lines, are alike, but not as nearly equal as those of wrapped prose; where items
are indented, the indentation recurs with the same period. Indentation that recurs and statement
punctuation mark program code, which is neither. What is left is judged by words: prose has common
words of some language, junk has none, or has noise inside its words, hardly any different words, or
repeats. The kind is the one that holds more than half of the characters.

Defined cases: null and blank texts have zero words and null ratios, and no kind; so have texts
shorter than min_chars (kind only); texts are judged whole however long; rows repeat freely; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.lookalikes import skeleton

_WORD = re.compile(r"[^\W_][\w'’̀-ͯ]*")
_ENDED = re.compile(r"[.!?…:;][\"'”’»)\]]*$")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s|$)")
_MARK = re.compile(r"^(?:[-*•‣◦·+–—>]|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)\]:]|[☐☑✓✔✗])\s+")
_NOISE = re.compile("[¿¶¢¤€™�\x80-\x9f\x00-\x08\x0e-\x1f]|Ã|Â|â|œ(?=[^a-zé])")
_PUNCT = re.compile(r"[^\w\s'’\-.̀-ͯ]")
_CODE = re.compile(
    r"^\s*(?:#(?!#)\s?\S|//|/\*|\*/|\"\"\"|def |class |return\b|for\b.*[:{]\s*$|if\b.*[:{;]\s*$|elif |else\b|while\b|import |from \w+ import|static |int |void |const |let |var |function |print\(|printf|try:|except|public |private |#include|\}|\{|@\w+$|[\w.\[\]]+\s*[-+*/]?=[^=]|[\w.]+\(.*\)[;:]?$|<\/?\w+[^>]*>$)|[;{}]\s*(?:/\*.*\*/|//.*|#.*)?$"
)
_MARKS = re.compile(r"[^\w\s\u0300-\u036f]")
_BREAK = re.compile("[\r\n\v\f\x85\u2028\u2029]+")
_ASCII_LETTERS = re.compile("[A-Za-z]+")
_GAP = re.compile(r"\S(?:[ ]{2,}|\t+)(?=\S)")
_HEX = re.compile(r"^(?:[0-9a-fA-F]{2,8}[:\s]*)+$")
_VOWELS = re.compile("[aeiouyäöüàâéèêëîïôûùáíóúœæаеёиоуыэюяіαειουηω]", re.I)
DELIMITERS = ("\t", "|", "│", ";", ",")
#: Autocorrelation of line lengths of a list at least, and of wrapped prose of at least so many characters a line.
REGULAR, WRAPPED, WRAPPED_CHARS = 0.6, 0.97, 36
_SYMBOL = re.compile(r"[^\w\s]|_")


def alignment(lines: list[str]) -> list[bool]:
    """Which lines stand in a run of at least three aligned records."""
    n = len(lines)
    out = [False] * n

    def mark(keys: list, good) -> None:
        i = 0
        while i < n:
            if keys[i] is None:
                i += 1
                continue
            j = i + 1
            while j < n and keys[j] == keys[i]:
                j += 1
            if j - i >= 3 and good(i, j):
                for k in range(i, j):
                    out[k] = True
            i = j

    def short_cells(d: str):
        def good(i: int, j: int) -> bool:
            cells = [c for l in lines[i:j] for c in l.strip().strip("|│").split(d)]
            filled = [c for c in cells if c.strip()]
            ends = sum(bool(_SENTENCE.search(c.strip())) for c in filled)
            return bool(filled) and sum(len(c.split()) for c in filled) <= 3.5 * len(filled) and ends <= 0.2 * len(filled)

        return good

    for d in DELIMITERS:
        least = 2 if d in ",;" else 1
        counts = [l.count(d) for l in lines]
        if max(counts, default=0) >= least:
            mark([c if c >= least else None for c in counts], short_cells(d))
    # columns of two or more blanks; a missing cell joins two gaps, so their number may differ
    if any("  " in l.strip() for l in lines):
        gaps = [len(_GAP.findall(l.strip())) for l in lines]
        mark([True if g >= 1 else None for g in gaps], lambda i, j: sum(gaps[i:j]) >= 1.5 * (j - i) and all(len(l.split()) <= 30 for l in lines[i:j]))
    # the same punctuation in the same order, as in key=value records
    marks = ["".join(_PUNCT.findall(l)) for l in lines]
    mark([m if len(m) >= 3 and len(set(m)) >= 1 and len(l) < 400 else None for m, l in zip(marks, lines)], lambda i, j: not any(_SENTENCE.search(l.strip()) for l in lines[i:j]))
    return out


def periodic_indentation(lines: list[str]) -> float:
    """Share of lines indented by a multiple of a common step of 2, 4 or 8 blanks or by tabs."""
    steps = [len(l) - len(l.lstrip(" ")) if not l.startswith("\t") else 4 for l in lines]
    deep = [s for s in steps if s]
    return sum(s % 2 == 0 for s in deep) / len(lines) if deep else 0.0


def autocorrelation(values: np.ndarray, lag: int) -> float:
    """Of values with those lag places on, from 0 (never both large) to 1 (the same)."""
    x, y = values[:-lag], values[lag:]
    power = float((x * x).sum() + (y * y).sum()) / 2
    return float((x * y).sum()) / power if power else 1.0


def regularity(lines: list[str], most_lines: int = 4) -> tuple[float, int]:
    """The largest autocorrelation of line lengths over periods of up to most_lines lines, and its period.
    Where lines are indented differently the indentation must recur with the same period."""
    n = np.array([len(l.strip()) for l in lines], float)
    deep = np.array([len(l) - len(l.lstrip()) for l in lines], float)
    best = (0.0, 1)
    for lag in range(1, min(most_lines, len(n) // 2) + 1):
        if deep.any() and len(set(deep)) > 1 and autocorrelation(deep, lag) < 0.9:
            continue
        r = autocorrelation(n, lag)
        if r > best[0] + 0.01:  # a longer period must be clearly better
            best = (r, lag)
    return best


def is_wrapped(lines: list[str]) -> bool:
    """Whether lines of running text were broken at one width: long and of nearly equal length."""
    n = np.array([len(l.strip()) for l in lines], float)
    return n.mean() >= WRAPPED_CHARS and autocorrelation(n, 1) >= WRAPPED


def repeated(text: str) -> bool:
    """Whether nearly everything is said before: the text packs to a small part of itself."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw) >= 200 and len(zlib.compress(raw, 1)) < max(0.16 * len(raw), 40)


@lru_cache(4)
def begun(common: frozenset[str]) -> frozenset[str]:
    """What stands before the apostrophe of common words that end with one, such as l'."""
    return frozenset(w[:-1] for w in common if w.endswith("'"))


def junk_words(words: list[str], line: str, common: frozenset[str]) -> bool:
    """Whether the words of a stretch of running text are noise."""
    visible = len(line) - line.count(" ")
    letters = sum(map(len, _ASCII_LETTERS.findall(line))) if line.isascii() else sum(map(str.isalpha, line))
    if not words or letters < 0.5 * visible:
        return True
    if len(_NOISE.findall(line)) > 0.035 * len(line):
        return True
    if len(words) > 12 and list(map(len, words)).count(1) > 0.6 * len(words):
        return True
    alone = begun(common)
    known = len([w for w in words if w in common or w in alone or "'" in w and w.split("'")[0] + "'" in common])
    if known >= 0.07 * len(words):
        if len(words) >= 40 and len(set(words)) < 0.12 * len(words):
            return True
        return False
    if len(words) < 8 and max(map(len, words)) < 30:
        vowels = sum(bool(_VOWELS.search(w)) for w in words)
        return vowels < 0.6 * len(words)
    return known < 0.035 * len(words) or not _SENTENCE.search(line)


def foreign_share(words: list[str], common: frozenset[str], window: int = 20) -> float:
    """Share of the windows of a long line that hold no common word at all."""
    parts = [words[i : i + window] for i in range(0, len(words), window)]
    without = sum(len(p) for p in parts if not any(w in common for w in p))
    return without / len(words)


def is_code(lines: list[str]) -> bool:
    """Statement punctuation and periodic indentation on most lines."""
    if len(lines) < 3:
        return False
    code = [bool(_CODE.search(l)) and not (len(l) > 40 and len(l.split()) == 1) for l in lines]
    if sum(code) < 0.3 * len(lines):
        return False
    indented = sum(c or l[:2] in ("  ", "\t\t") or l[:1] == "\t" for c, l in zip(code, lines))
    return indented > 0.5 * len(lines) and (sum(code) > 0.5 * len(lines) or periodic_indentation(lines) >= 0.2)


def is_list(lines: list[str], words: list[list[str]]) -> bool:
    """Whether a run of item-like lines is a list: marked, or of regular lengths and neither wrapped nor punctuated inside."""
    marked = sum(bool(_MARK.match(l.lstrip())) for l in lines)
    if marked < 0.6 * len(lines):
        inside = sum(bool(re.search(r"[.,;:!?]\s", l.strip())) for l in lines)
        if regularity(lines)[0] < REGULAR or is_wrapped(lines) or inside > 0.15 * len(lines):
            return False
    run = [w for x in words for w in x]
    voiced = sum(bool(_VOWELS.search(w)) or w[0].isdigit() for w in run)
    text = "".join(l.strip() for l in lines)
    return voiced >= 0.6 * len(run) and sum(map(str.isalpha, text)) >= 0.4 * len(text)


def shares(text: str, common: frozenset[str]) -> tuple[float, float, float]:
    """Shares of the characters that stand in lists, in tables and in junk."""
    if not text.isascii():
        if len(_NOISE.findall(text)) > 0.035 * len(text):
            return 0.0, 0.0, 1.0
        form = skeleton(text.lower())
    else:
        form = text.lower()
    if repeated(form):
        return 0.0, 0.0, 1.0
    lines = [l for l in _BREAK.split(form) if l and not l.isspace()]
    total = sum(len(l.strip()) for l in lines)
    if not total or is_code(lines):
        return 0.0, 0.0, 0.0
    aligned = alignment(lines)
    words = [_WORD.findall(l.replace("’", "'")) for l in lines]
    size = [len(l.strip()) for l in lines]
    kinds: list[str] = []
    for l, a, w in zip(lines, aligned, words):
        s = l.strip()
        known = sum(x in common for x in w)
        if sum(map(len, w)) < 0.4 * len("".join(s.split())) and not (a and ("|" in s or "-" in s) and not s.strip("|-+: =")) and len(_MARKS.findall(s)) > 0.5 * len("".join(s.split())) and not (a and w):
            kinds.append("junk")
        elif _HEX.match(s) and len(s) > 8 and not s.isdigit() or len(s) > 40 and " " not in s and "://" not in s and not a:
            kinds.append("junk")
        elif a and not (known > 0.25 * len(w) and len(w) > 12):
            kinds.append("table")
        elif len(s) <= 80 and 1 <= len(w) <= 9 and max(map(len, s.split())) <= 30 and (_MARK.match(s) and not (len(w) > 6 and _SENTENCE.search(s)) or not _ENDED.search(s)) and known <= 0.5 * len(w):
            kinds.append("item")
        else:
            kinds.append("text")
    i = 0
    while i < len(kinds):  # items in runs of at least three lines are a list; scattered ones are headings
        j = i
        while j < len(kinds) and kinds[j] == "item":
            j += 1
        if j > i:
            kinds[i:j] = ["list" if j - i >= 3 and is_list(lines[i:j], words[i:j]) else "text"] * (j - i)
        i = max(j, i + 1)
    # noise between rows that look aligned by chance is noise too
    noise = sum(n for n, k in zip(size, kinds) if k == "junk")
    if noise > 0.3 * total and sum(map(len, (w for x in words for w in x))) < 0.4 * len("".join(form.split())):
        return 0.0, 0.0, 1.0
    short, mixed = [], 0.0
    for k, kind in enumerate(kinds):
        if kind == "text":
            if len(words[k]) >= 12:
                kinds[k] = "junk" if junk_words(words[k], lines[k].strip(), common) else "prose"
                if kinds[k] == "prose" and len(words[k]) >= 40:  # noise after a sentence of prose
                    mixed += size[k] * foreign_share(words[k], common)
            else:
                short.append(k)
    if short and junk_words([w for k in short for w in words[k]], " ".join(lines[k].strip() for k in short), common):
        for k in short:
            kinds[k] = "junk"
    part = [sum(n for n, k in zip(size, kinds) if k == name) / total for name in ("list", "table", "junk")]
    return part[0], part[1], part[2] + mixed / total


def statistics(text: str | None, common: frozenset[str]) -> tuple:
    """(words, mean_word_length, symbol_share, ended_lines, common_share) of a text as stored."""
    if text is None:
        return 0, None, None, None, None
    words = _WORD.findall(text)
    lines = [l for l in text.splitlines() if l.strip()]
    if not words and not lines:
        return 0, None, None, None, None
    n = len(words)
    symbols = len(_SYMBOL.findall(text))
    return (
        n,
        sum(map(len, words)) / n if n else None,
        symbols / len(text),
        sum(bool(_ENDED.search(l.rstrip())) for l in lines) / len(lines) if lines else None,
        sum(w.lower() in common for w in words) / n if n else None,
    )


def kind_of(listed: float, table: float, junk: float) -> str | None:
    """The kind that holds more than half of the characters."""
    for name, share in (("list", listed), ("table", table), ("junk", junk)):
        if share > 0.5:
            return name
    return None


def _rows(common: frozenset[str], min_chars: int, full: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                stats = statistics(text, common) if full else ()
                three = shares(text, common) if text is not None and len(text) >= min_chars else (0.0, 0.0, 0.0)
                kind = kind_of(*three)
                if full:
                    out.append((key, *stats, *three, kind))
                elif kind:
                    out.append((key, kind))
            types = [pa.int64(), pa.int32(), *[pa.float64()] * 7, pa.string()] if full else [pa.int64(), pa.string()]
            columns = zip(*out) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f"c{i}" for i in range(len(types))])

    return rows


def _common(words: DataFrame) -> frozenset[str]:
    """The words, and the forms they have after skeleton()."""
    plain = {r["word"].lower() for r in words.where("word IS NOT NULL").select("word").distinct().collect()}  # a table of fixed length
    return frozenset(plain | {skeleton(w) for w in plain})


def quality_statistics(df: DataFrame, common_words: DataFrame, key: str = "ord", text: str = "text", min_chars: int = 200) -> DataFrame:
    """One row per row of df with its statistics, shares and kind (null for prose, code and short texts)."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        _rows(_common(common_words), min_chars, True),
        "c0 long, c1 int, c2 double, c3 double, c4 double, c5 double, c6 double, c7 double, c8 double, c9 string",
    )
    return rows.toDF(key, "words", "mean_word_length", "symbol_share", "ended_lines", "common_share", "list_share", "table_share", "junk_share", "kind")


def unnatural_texts(df: DataFrame, common_words: DataFrame, key: str = "ord", text: str = "text", min_chars: int = 200) -> DataFrame:
    """(key, kind) of the rows that are mostly a list, a table or junk."""
    rows = df.where(F.length(text) >= min_chars).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_rows(_common(common_words), min_chars, False), "c0 long, c1 string").toDF(key, "kind")
