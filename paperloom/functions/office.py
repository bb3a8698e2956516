"""Expressions on office paragraphs: numbers, labels, colours, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import group, let, lookup, lstrip, strip, sub

ROMAN_HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]
ROMAN_TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
ROMAN_ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]


def heading_hint(name: Column) -> Column:
    return group(name, K.HEADING_HINT, 1).try_cast("int")


def alpha(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA (bijective base 26)."""
    # 14 letters cover every 64-bit number
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(14)),
        F.struct(n.cast("long").alias("rest"), F.lit("").alias("text")),
        lambda s, _: F.when(
            s["rest"] > 0,
            F.struct(
                F.floor((s["rest"] - 1) / 26).cast("long").alias("rest"),
                F.concat(F.char(65 + (s["rest"] - 1) % 26), s["text"]).alias("text"),
            ),
        ).otherwise(s),
        lambda s: s["text"],
    )
    return F.when(n > 0, done).otherwise(F.lit("A"))


def roman(n: Column) -> Column:
    def digit(table: list[str], place: int) -> Column:
        return F.get(F.array(*[F.lit(x) for x in table]), (F.floor(n / place) % 10).cast("int"))

    whole = F.concat(
        F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")),
        digit(ROMAN_HUNDREDS, 100), digit(ROMAN_TENS, 10), digit(ROMAN_ONES, 1),
    )
    return F.when(n > 0, whole).otherwise(F.lit("I"))


def number_label(n: Column, fmt: Column) -> Column:
    return (
        F.when(fmt == "upperLetter", alpha(n))
        .when(fmt == "lowerLetter", F.lower(alpha(n)))
        .when(fmt == "upperRoman", roman(n))
        .when(fmt == "lowerRoman", F.lower(roman(n)))
        .otherwise(n.cast("string"))
    )


def property_key(name: Column) -> Column:
    return F.btrim(sub(F.lower(strip(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def theme_key(name: Column) -> Column:
    key = F.lower(F.replace(F.replace(strip(name), F.lit("_"), F.lit("")), F.lit("-"), F.lit("")))
    return F.coalesce(lookup(key, K.THEME_ALIASES), key)


def shaded_color(hex_: Column, tint: Column, shade: Column) -> Column:
    """Tint towards white, then shade towards black, per channel."""

    def share(v: Column) -> Column:
        return F.conv(v, 16, 10).cast("double") / F.lit(255.0)

    def channel(i: int) -> Column:
        c = F.conv(F.substring(F.ltrim(hex_, F.lit("#")), 2 * i + 1, 2), 16, 10).cast("double")
        c = F.when(tint != "", F.bround(c + (F.lit(255.0) - c) * share(tint), 0)).otherwise(c)
        c = F.when(shade != "", F.bround(c * share(shade), 0)).otherwise(c)
        return F.lpad(F.hex(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)).cast("long")), 2, "0")

    rgb = F.concat(F.lit("#"), channel(0), channel(1), channel(2))
    return F.when(hex_.isNotNull(), rgb)


def callout_title(text: Column, fill: Column) -> Column:
    """Title of a one-cell table that is a callout, by fill colour or by prefix."""
    upper = F.upper(text)
    by_prefix = F.coalesce(
        *[
            F.when(upper.startswith(p) | upper.startswith(f"[{p}]"), F.lit(title))
            for p, title in K.CALLOUT_PREFIXES.items()
        ]
    )
    return F.coalesce(lookup(F.upper(fill), K.CALLOUT_FILLS), by_prefix)


def callout_body(text: Column, title: Column) -> Column:
    upper = F.upper(text)
    chain = F
    for p, canonical in K.CALLOUT_PREFIXES.items():
        for shown in (f"[{p}]", p):
            rest = F.substring(text, F.lit(len(shown) + 1), F.length(text))
            chain = chain.when(
                (title == canonical) & upper.startswith(shown), lstrip(F.ltrim(rest, F.lit(":")))
            )
    return chain.otherwise(text)


def is_file_name(value: Column) -> Column:
    base = F.regexp_extract(strip(value), r"([^/]*)$", 1)
    return (base != "") & base.rlike(K.IMAGE_FILE_NAME)


def alt_text(descr: Column, title: Column, name: Column) -> Column:
    """Human-written description; file names and ``Picture N`` do not count."""

    def given(v: Column) -> Column:
        return let(strip(F.coalesce(v, F.lit(""))), lambda t: F.when((t != "") & ~is_file_name(t), t))

    return F.coalesce(
        given(descr), given(title),
        let(given(name), lambda n: F.when(~n.rlike(K.PICTURE_NAME), n)), F.lit(""),
    )


def bookmark_parts(name: Column) -> Column:
    """``struct<type, extra>`` of a semantic bookmark, null for any other name."""
    kind = group(name, K.BOOKMARK, 1)
    rest = group(name, K.BOOKMARK, 2)
    extra = F.when(rest.rlike(r"(?i)^[0-9a-f]{4}$"), F.lit("")).otherwise(
        F.btrim(sub(rest, r"(?i)_[0-9a-f]{4}$"), F.lit("_"))
    )
    return F.when(name.rlike(K.BOOKMARK), F.struct(kind.alias("type"), extra.alias("extra")))


