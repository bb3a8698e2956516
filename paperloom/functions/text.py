"""Small text helpers shared by all operators (pure Column expressions)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    The value is bound to a lambda variable, so the optimizer cannot copy its
    expression into every place (or every loop step) that reads it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(K.WHITESPACE))


def strip_bound(x: Column) -> Column:
    """``strip`` of a lambda variable: a text with plain ASCII at both ends is left alone, which costs a fraction of a trim.

    ``x`` is read several times, so it must be cheap to evaluate.
    """
    last = F.substring(x, -1, 1)
    return F.when((x >= "!") & (x < "\x7f") & (last >= "!") & (last < "\x7f"), x).otherwise(strip(x))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(K.WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(K.WHITESPACE))


def sub(c: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def group(c: Column, pattern: str, idx: int = 1) -> Column:
    return F.regexp_extract(c, pattern, idx)


def any_of(words: Iterable[str]) -> str:
    """Alternation of literal words for Java regex."""
    return "|".join("".join("\\" + ch if ch in r"\.[]{}()*+-?^$|&#~" else ch for ch in w) for w in words)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True if any literal word occurs; one regex pass."""
    return c.rlike(any_of(words))


def count_char(c: Column, chars: str) -> Column:
    """Number of characters of ``c`` that belong to ``chars``."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Map a key through a small fixed table (no join needed)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def strip_anchors(c: Column) -> Column:
    """Drop empty anchors that only carry an id."""
    return F.when(F.contains(F.lower(c), F.lit("<a")), sub(c, K.ANCHOR)).otherwise(c)


def unescape(c: Column) -> Column:
    """Remove Markdown escapes, keep outer spaces."""
    return sub(c, K.ESCAPES, "$1")


def unescape_strip(c: Column) -> Column:
    return strip(unescape(c))


def normalize_spacing(c: Column) -> Column:
    """Collapse blanks and drop the spaces just inside parentheses."""
    c = sub(c, r"[ \t]{2,}", " ")
    c = sub(c, r"(?U)\([\s\x1c-\x1f]+", "(")
    c = sub(c, r"(?U)[\s\x1c-\x1f]+\)", ")")
    return strip(c)


def normalize_inline(c: Column) -> Column:
    """Comparison form of a one-line text."""
    return sub(strip(c), r"[ \t]+", " ")


def normalize_block(c: Column) -> Column:
    """Comparison form of a multi-line text: no outer blank lines, right-trimmed lines."""
    lines = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    joined = F.array_join(F.transform(lines, rstrip), "\n")
    return F.btrim(joined, F.lit("\n"))


def is_digits(c: Column) -> Column:
    return c.rlike(r"(?U)^\d+$")


def has_digit(c: Column) -> Column:
    return c.rlike(K.DIGIT)


def cut(c: Column, pattern: str) -> Column:
    """Split around every match and keep the matches as own pieces."""
    marked = F.regexp_replace(c, F.lit(pattern), F.lit(f"{K.CUT}$0{K.CUT}"))
    return F.split(marked, K.CUT, -1)


def round_half_even(c: Column) -> Column:
    return F.bround(c, 0)
