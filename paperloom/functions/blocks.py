"""Fields of one block, computed from its class code and its source lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .lexer import TYPES, fenced_body
from .text import (
    any_of, count_char, group, let, lookup, normalize_spacing, rstrip, strip, strip_anchors, sub,
    unescape_strip,
)

HEADING_TYPES = ("HEADING_1", "HEADING_2", "HEADING_3", "HEADING_4", "NUMBERED_HEADING")


def block_type(code: Column) -> Column:
    return lookup(code, TYPES)


def is_heading(code: Column) -> Column:
    return F.contains(F.lit("1234Wh"), code)


def first_line(lines: Column) -> Column:
    return F.get(lines, F.lit(0))


def trimmed_line(lines: Column) -> Column:
    return strip(strip_anchors(strip(first_line(lines))))


def heading_level(code: Column) -> Column:
    return lookup(code, {"1": "1", "2": "2", "3": "3", "4": "4", "W": "1", "h": "2"}).cast("int")


def heading_text(code: Column, lines: Column) -> Column:
    s = trimmed_line(lines)
    marked = F.when(F.contains(F.lit("1234"), code), sub(s, r"(?U)^#{1,4}\s+")).otherwise(s)
    return unescape_strip(marked)


def paragraph_text(lines: Column, keep_double_space: bool = False) -> Column:
    """Join wrapped lines: soft wraps become a blank, hard breaks a newline."""

    def piece(working: Column) -> Column:
        br, slash = r"(?iU)<br\s*/?>\s*$", r"(?U)(?<!\\)\\\s*$"
        body = (
            F.when(working.rlike(br), F.concat(normalize_spacing(sub(working, br)), F.lit(K.HARD)))
            .when(
                working.rlike(slash),
                F.concat(normalize_spacing(sub(working, r"(?U)\\\s*$")), F.lit(K.HARD)),
            )
        )
        if keep_double_space:
            body = body.when(
                working.rlike(r"[ \t]{2,}$"), F.concat(normalize_spacing(working), F.lit(K.HARD))
            )
        return body.otherwise(F.concat(normalize_spacing(working), F.lit(K.SOFT)))

    joined = F.array_join(F.transform(F.transform(lines, strip_anchors), piece), "")
    # the last break before the next text decides, empty pieces only carry their break
    joined = sub(joined, f"[{K.HARD}{K.SOFT}]*{K.HARD}(?![{K.HARD}{K.SOFT}])", "\n")
    joined = sub(joined, f"[{K.HARD}{K.SOFT}]*{K.SOFT}", " ")
    return strip(joined)


def indent_level(prefix: Column) -> Column:
    return F.floor(F.length(F.replace(prefix, F.lit("\t"), F.lit("    "))) / 2).cast("int")


def quote_lines(lines: Column) -> Column:
    return F.transform(lines, lambda x: unescape_strip(group(strip(x), K.QUOTE, 1)))


def quote_parts(lines: Column) -> Column:
    """``struct<title, text>`` of a callout."""
    label = rf"(?iuUd)^\[({any_of(K.CALLOUT_LABELS)})\]\s*(.*)"

    def parts(q: Column) -> Column:
        head = F.get(q, F.lit(0))
        named = head.rlike(label)
        rest = F.slice(q, F.lit(2), F.greatest(F.size(q) - 1, F.lit(0)))
        remainder = strip(group(head, label, 2))
        body = F.when(
            named, F.concat(F.when(remainder != "", F.array(remainder)).otherwise(F.array().cast("array<string>")), rest)
        ).otherwise(q)
        return F.struct(
            F.when(named, F.upper(group(head, label, 1))).otherwise(F.lit(K.DEFAULT_CALLOUT)).alias("title"),
            strip(F.array_join(body, " ")).alias("text"),
        )

    return let(quote_lines(lines), parts)


def code_text(lines: Column) -> Column:
    return rstrip(F.array_join(fenced_body(lines, K.FENCE), "\n"))


def code_language(lines: Column) -> Column:
    return group(trimmed_line(lines), K.FENCE, 1)


def is_ascii_art(text: Column) -> Column:
    return count_char(text, K.BOX_CHARS) >= K.BOX_THRESHOLD


def math_text(code: Column, lines: Column) -> Column:
    return F.when(code == "L", strip(group(trimmed_line(lines), K.MATH_LINE, 1))).otherwise(
        strip(F.array_join(fenced_body(lines, K.MATH_FENCE), "\n"))
    )


def image_source(lines: Column) -> Column:
    """Embedded image line, wrapped lines joined."""
    return strip(
        F.array_join(F.transform(lines, lambda x, i: F.when(i == 0, rstrip(x)).otherwise(strip(x))), "")
    )


def image_parts(code: Column, lines: Column) -> Column:
    """``struct<alt_text, path, mime, data>`` of an image block."""
    embedded = code == "I"
    source = F.when(embedded, image_source(lines)).otherwise(trimmed_line(lines))
    return let(
        source,
        lambda s: F.struct(
            F.when(embedded, group(s, K.DATA_IMAGE, 1)).otherwise(group(s, K.IMAGE, 1)).alias("alt_text"),
            F.when(embedded, F.lit("")).otherwise(group(s, K.IMAGE, 2)).alias("path"),
            F.when(embedded, group(s, K.DATA_IMAGE, 2)).alias("mime"),
            F.when(embedded, F.translate(group(s, K.DATA_IMAGE, 3), "\n\r ", "")).alias("data"),
        ),
    )


def item_text(code: Column, lines: Column) -> Column:
    raw = first_line(lines)
    return F.when(F.contains(F.lit("Bx"), code), group(raw, K.BULLET, 2)).otherwise(
        group(raw, K.NUMBERED, 3)
    )


def item_indent(code: Column, lines: Column) -> Column:
    raw = first_line(lines)
    return indent_level(
        F.when(F.contains(F.lit("Bx"), code), group(raw, K.BULLET, 1)).otherwise(group(raw, K.NUMBERED, 1))
    )


def block_text(code: Column, lines: Column, keep_double_space: bool = False) -> Column:
    """Main text of a block; null for separators, tables and images."""
    return (
        F.when(code == "P", paragraph_text(lines, keep_double_space))
        .when(is_heading(code), heading_text(code, lines))
        .when(F.contains(F.lit("BxNy"), code), item_text(code, lines))
        .when(code == "Q", quote_parts(lines)["text"])
        .when(F.contains(F.lit("FD"), code), code_text(lines))
        .when(F.contains(F.lit("LM"), code), math_text(code, lines))
    )


def raw_text(code: Column, lines: Column, text: Column) -> Column:
    """Source form kept with a block."""
    s = trimmed_line(lines)
    return (
        F.when(code == "P", text)
        .when(code == "T", F.array_join(F.transform(lines, strip), "\n"))
        .when(code == "Q", F.array_join(quote_lines(lines), "\n"))
        .when(code == "M", F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .when(code == "I", F.when(F.length(s) > 100, F.concat(F.left(s, F.lit(100)), F.lit("..."))).otherwise(s))
        .when(F.contains(F.lit("1234WhGL"), code), s)
        .otherwise(first_line(lines))
    )


def has_inline_math(text: Column) -> Column:
    return text.rlike(K.INLINE_MATH_UNESCAPED)


def bold_pair(text: Column) -> Column:
    """``struct<key, value>`` of a ``**key**: value`` paragraph, null otherwise."""
    return let(
        text,
        lambda t: F.when(
            t.rlike(K.BOLD_PAIR),
            F.struct(
                strip(group(t, K.BOLD_PAIR, 1)).alias("key"),
                strip(group(t, K.BOLD_PAIR, 2)).alias("value"),
            ),
        ),
    )
