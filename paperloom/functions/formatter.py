"""Give collapsed report text its line structure back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import any_of, cut, let, rstrip, strip, sub

NEWLINES = r"\r\n?"


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def needs_formatting(text: Column) -> Column:
    unified = sub(text, NEWLINES, "\n")
    n, size = newline_count(unified), F.length(unified)
    return ((n == 0) & (size > 100)) | ((n < 5) & (size > 500))


def has_structure(text: Column) -> Column:
    return newline_count(text) > 20


# --- protected spans ----------------------------------------------------------

def hide_spans(text: Column, pattern: str, mark: str) -> Column:
    """``struct<text, store>``: matches moved to ``store``, numbered marks left behind."""
    return let(
        cut(text, pattern),
        lambda p: F.struct(
            F.array_join(
                F.transform(
                    p,
                    lambda x, i: F.when(
                        i % 2 == 1, F.concat(F.lit(mark), F.floor(i / 2).cast("string"), F.lit(mark))
                    ).otherwise(x),
                ),
                "",
            ).alias("text"),
            F.filter(p, lambda x, i: i % 2 == 1).alias("store"),
        ),
    )


def show_spans(text: Column, store: Column, mark: str, around: str = "") -> Column:
    return F.array_join(
        F.transform(
            F.split(text, mark, -1),
            lambda x, i: F.when(
                i % 2 == 1, F.concat(F.lit(around), F.get(store, x.try_cast("int")), F.lit(around))
            ).otherwise(x),
        ),
        "",
    )


def shielded(text: Column, body) -> Column:
    """Apply ``body`` with ``$$..$$``, ``$..$`` and ``**..**`` out of its reach.

    ``body`` gets the text and a ``restore`` function.
    """
    return let(
        hide_spans(text, K.MATH_SPAN, K.PART),
        lambda m: let(
            hide_spans(m["text"], K.INLINE_MATH, K.HARD),
            lambda i: let(
                hide_spans(i["text"], K.BOLD_SPAN, K.SOFT),
                lambda b: body(
                    b["text"],
                    lambda t: show_spans(
                        show_spans(show_spans(t, b["store"], K.SOFT), m["store"], K.PART, "\n\n"), i["store"], K.HARD
                    ),
                ),
            ),
        ),
    )


def outside_bold(text: Column, body) -> Column:
    return let(hide_spans(text, K.BOLD_SPAN, K.SOFT), lambda b: show_spans(body(b["text"]), b["store"], K.SOFT))


# --- single steps -------------------------------------------------------------

def colon_spacing(text: Column) -> Column:
    """One space after ``:`` except URLs, paths, digit pairs and ``::``."""
    # the colon comes first: it is rare, look-behinds at every character are not cheap
    return sub(text, r"(?U):(?<!::)(?=[^\s:/\\])(?!(?<=\d:)\d)", ": ")


def label_spacing(text: Column) -> Column:
    return sub(text, rf"(?U):(?<=(?:{any_of(K.SPACING_LABELS)}):)\s*", ": ")


def label_breaks(text: Column) -> Column:
    return sub(text, rf"(?<=[가-힣a-zA-Z0-9.%)\]])((?:{any_of(K.BREAK_LABELS)}):)", "\n\n- $1")


def head_fields(text: Column) -> Column:
    """``struct<title, fields, rest>``: report head fields cut out of the text."""
    return let(text, _head_fields)


def _head_fields(text: Column) -> Column:
    stop = "|".join([*K.HEAD_LABELS.values(), K.HEAD_NEXT_HEADING, K.HEAD_NEXT_LABEL])

    def take(state: Column, name: str, pattern: str) -> Column:
        whole = rf"(?sU)^(.*?){pattern}(.*?)(?=(?:{stop})|\z)(.*)$"
        return let(
            state,
            lambda s: F.when(
                s["rest"].rlike(rf"(?U){pattern}"),
                F.struct(
                    s["title"].alias("title"),
                    F.concat(
                        s["fields"],
                        F.array(
                            F.struct(
                                F.lit(name).alias("key"), strip(F.regexp_extract(s["rest"], whole, 2)).alias("value")
                            )
                        ),
                    ).alias("fields"),
                    F.regexp_replace(s["rest"], F.lit(whole), F.lit("$1$3")).alias("rest"),
                ),
            ).otherwise(s),
        )

    state = F.struct(
        F.when(text.rlike(K.HEAD_TITLE), strip(F.regexp_extract(text, K.HEAD_TITLE, 1))).alias("title"),
        F.array().cast("array<struct<key:string,value:string>>").alias("fields"),
        sub(text, K.HEAD_TITLE).alias("rest"),
    )
    for name, pattern in K.HEAD_LABELS.items():
        state = take(state, name, pattern)
    return let(
        state,
        lambda s: F.struct(s["title"].alias("title"), s["fields"].alias("fields"), strip(s["rest"]).alias("rest")),
    )


def head_frontmatter(head: Column) -> Column:
    def line(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'{key}: "'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))

    def field(name: str) -> Column:
        return F.get(F.filter(head["fields"], lambda f: f["key"] == name), F.lit(0))["value"]

    lines = F.array(
        line("title", head["title"]), *[line(key, field(name)) for name, key in K.HEAD_KEYS.items()]
    )
    return let(
        F.filter(lines, lambda x: x.isNotNull()),
        lambda x: F.when(
            F.size(x) > 0, F.concat(F.lit("---\n"), F.array_join(x, "\n"), F.lit("\n---"))
        ).otherwise(F.lit("")),
    )


def insert_headings(text: Column) -> Column:
    text = sub(text, K.SUB_HEADING, "\n\n### $1. $2")
    text = sub(text, K.SUBSUB_HEADING, "\n\n#### $1. $2")
    # boundary before the number, and a title of at most 45 trimmed characters
    letter, more = "[가-힣A-Z]", r"[가-힣a-zA-Z\s()\-:]"
    guard = rf"(?!\d{{1,2}}\.\s+{letter}{more}{{44,49}}[가-힣a-zA-Z()\-:])"
    boundary = r"(?<!\d\.)(?<!\d\.\n)(?:^|(?<=[ \n\t.\])]))"
    return sub(text, rf"(?U)(?=\d){boundary}{guard}" + K.MAJOR_HEADING.removeprefix("(?U)"), "\n\n## $1. $2")


def insert_callouts(text: Column, light: bool = False) -> Column:
    return sub(text, K.LIGHT_CALLOUT if light else K.INLINE_CALLOUT, "\n\n> [$1]")


def insert_bullets(text: Column) -> Column:
    return sub(text, K.BULLET_SIGNS, "\n\n- ")


def split_sentences(text: Column) -> Column:
    return sub(text, rf"\.(?<=(?:{K.SENTENCE_ENDINGS})\.)(?={K.SENTENCE_FOLLOWERS})", ".\n\n")


def split_at_starters(text: Column) -> Column:
    return sub(text, rf"(?<!: )({any_of(K.PARAGRAPH_OPENERS)})", "\n\n$1")


def insert_structure(text: Column) -> Column:
    return split_at_starters(split_sentences(insert_bullets(insert_callouts(insert_headings(text)))))


def tidy(text: Column) -> Column:
    text = sub(text, NEWLINES, "\n")
    text = sub(text, r"\n{3,}", "\n\n")
    for opener in (r"#{1,4}\s", r"\$\$"):
        text = sub(text, rf"(?U)([^\n])\n({opener})", "$1\n\n$2")
    text = sub(text, r"(\$\$)\n([^\n])", "$1\n\n$2")
    for opener in (r">\s", r"-\s"):
        text = sub(text, rf"(?U)([^\n])\n({opener})", "$1\n\n$2")
    lines = F.transform(F.split(text, "\n", -1), rstrip)
    return strip(F.array_join(lines, "\n"))


def light_format(text: Column) -> Column:
    spaced = outside_bold(text, lambda t: label_spacing(colon_spacing(t)))
    return strip(sub(insert_callouts(spaced, light=True), r"\n{3,}", "\n\n"))


def full_format(text: Column) -> Column:
    def body(t: Column, restore) -> Column:
        return let(
            head_fields(label_spacing(colon_spacing(t))),
            lambda h: let(
                F.struct(
                    restore(head_frontmatter(h)).alias("front"),
                    tidy(restore(label_breaks(insert_structure(h["rest"])))).alias("body"),
                ),
                lambda r: F.when(r["front"] == "", r["body"]).otherwise(
                    F.concat(r["front"], F.lit("\n\n"), r["body"])
                ),
            ),
        )

    return shielded(text, body)


def format_text(text: Column) -> Column:
    return F.when(has_structure(text), light_format(text)).otherwise(full_format(text))
