"""Character classes that mean the same in Python's str methods, Java and RE2 patterns.

Fixed values: Python's \\s, \\w, isalpha and isalnum on str, written out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x1f \x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
ALPHA = r"\p{L}"
ALNUM = r"[\p{L}\p{N}]"
UPPER = r"\p{Lu}"


def count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def words(c: Column | str) -> Column:
    """The parts between blanks, as str.split() gives them."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
