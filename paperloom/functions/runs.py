"""Styled spans of a text: colour, then math, then bold / italic / super / sub."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import blocks as B
from . import constants as K
from .tables import table_cell_texts
from .text import cut, group, let, strip, unescape

RUN = "struct<text:string,bold:boolean,italic:boolean,superscript:boolean,subscript:boolean,is_latex:boolean,color_hex:string>"


#: Characters without which a text is one plain run.
MARKS = r"[\\*_^~$<]"


def color_pieces(text: Column) -> Column:
    """``array<struct<text, color>>``; spans without a hex colour stay text."""
    open_, mid, close = K.HARD, K.PART, K.SOFT

    def colored(t: Column) -> Column:
        # mark every span, keep the mark only where the style holds a colour
        marked = F.regexp_replace(t, F.lit(K.COLOR_SPAN), F.lit(f"{open_}$2{mid}$0{mid}$3{close}"))
        kept = F.regexp_replace(
            marked,
            F.lit(f"(?is){open_}(?![^{mid}]*?color\\s*:\\s*#[0-9A-Fa-f]{{6}})[^{mid}]*{mid}([^{mid}]*){mid}[^{close}]*{close}"),
            F.lit("$1"),
        )
        pieces = F.split(kept, f"(?={open_})|(?<={close})", -1)

        def one(p: Column) -> Column:
            span = p.startswith(open_)
            style = F.get(F.split(F.ltrim(p, F.lit(open_)), mid), F.lit(0))
            inner = F.rtrim(F.get(F.split(p, mid), F.lit(2)), F.lit(close))
            return F.struct(
                F.when(span, inner).otherwise(p).alias("text"),
                F.when(span, F.upper(group(style, K.STYLE_COLOR, 1))).alias("color"),
            )

        return F.transform(pieces, one)

    return F.when(F.contains(F.lower(text), F.lit("<span")), colored(text)).otherwise(
        F.array(F.struct(text.alias("text"), F.lit(None).cast("string").alias("color")))
    )


def _style(piece: Column, color: Column) -> Column:
    def wrapped(mark: str, longer: int) -> Column:
        return piece.startswith(mark) & piece.endswith(mark) & (F.length(piece) > longer)

    def inner(n: int) -> Column:
        return strip(unescape(F.substring(piece, F.lit(n + 1), F.length(piece) - 2 * n)))

    bold, sup, low = wrapped("**", 4), wrapped("^", 2), wrapped("~", 2)
    italic = wrapped("*", 2) | wrapped("_", 2)
    kind = (
        F.when(bold, F.lit("b")).when(sup, F.lit("^")).when(low, F.lit("~")).when(italic, F.lit("i"))
        .otherwise(F.lit(""))
    )
    return let(
        kind,
        lambda k: F.struct(
            F.when(k == "b", inner(2)).when(k == "", unescape(piece)).otherwise(inner(1)).alias("text"),
            (k == "b").alias("bold"),
            (k == "i").alias("italic"),
            (k == "^").alias("superscript"),
            (k == "~").alias("subscript"),
            F.lit(False).alias("is_latex"),
            color.alias("color_hex"),
        ).cast(RUN),
    )


def _plain(text: Column, color: Column) -> Column:
    return F.when(
        text.rlike(r"[*_^~]"), F.transform(cut(text, K.INLINE_MARKS), lambda p: _style(p, color))
    ).otherwise(F.array(_unstyled(unescape(text), color, False)))


def _unstyled(text: Column, color: Column, math: bool) -> Column:
    no = F.lit(False)
    return F.struct(
        text.alias("text"), no.alias("bold"), no.alias("italic"), no.alias("superscript"),
        no.alias("subscript"), F.lit(math).alias("is_latex"), color.alias("color_hex"),
    ).cast(RUN)


def _with_math(text: Column, color: Column, math: Column) -> Column:
    def one(p: Column) -> Column:
        return F.when(
            p.startswith(K.PART), F.array(_unstyled(F.substring(p, 2, 2147483647), color, True))
        ).otherwise(_plain(p, color))

    marked = F.regexp_replace(text, F.lit(K.INLINE_MATH), F.lit(f"{K.CUT}{K.PART}$1{K.CUT}"))
    return F.when(
        math & F.contains(text, F.lit("$")),
        F.flatten(F.transform(F.filter(F.split(marked, K.CUT, -1), lambda p: p != ""), one)),
    ).otherwise(_plain(text, color))


def inline_runs(text: Column, math: bool | Column = True, bound: bool = False) -> Column:
    """Runs of a text in order; ``math=False`` leaves ``$`` alone (currency-safe).

    ``bound`` says that ``text`` is a column of its own, cheap to read again.
    """

    def runs(s: Column) -> Column:
        if math is False:
            return _plain(s["text"], s["color"])
        return _with_math(s["text"], s["color"], F.lit(True) if math is True else math)

    def marked(t: Column) -> Column:
        pieces = let(F.replace(t, F.lit("\\*\\*"), F.lit("**")), color_pieces)
        return F.filter(F.flatten(F.transform(pieces, runs)), lambda r: r["text"] != "")

    # a text without any mark is one run, an empty one none
    one = lambda t: F.when(t != "", F.array(_unstyled(t, F.lit(None).cast("string"), False))).otherwise(F.array().cast(f"array<{RUN}>"))
    either = lambda t: F.when(~t.rlike(MARKS), one(t)).otherwise(marked(t))
    return either(text) if bound else let(text, either)


def cell_runs(text: Column) -> Column:
    """Runs of a table cell: math only where a balanced ``$...$`` exists."""
    return inline_runs(text, math=cell_math(text))


def cell_math(text: Column) -> Column:
    return F.contains(text, F.lit("$")) & text.rlike(K.INLINE_MATH)


def flowing_text(code: Column, lines: Column) -> Column:
    """Text of the blocks that flow: paragraphs and list items."""
    return F.when(code == "P", B.paragraph_text(lines)).when(
        F.contains(F.lit("BxNy"), code), B.item_text(code, lines)
    )


def block_run_arrays(code: Column, lines: Column) -> Column:
    """All runs of a block; the runs of a table are those of its cells."""
    cells = let(table_cell_texts(lines), lambda rows: F.flatten(F.transform(F.flatten(rows), cell_runs)))
    return F.when(code == "T", cells).otherwise(
        F.coalesce(inline_runs(flowing_text(code, lines)), F.array().cast(f"array<{RUN}>"))
    )


def block_run_counts(code: Column, lines: Column) -> Column:
    """``run_counts_of(block_run_arrays(...))``; only texts with a star or an underscore have bold or italic runs to look for."""
    marked = lambda x: F.contains(x, F.lit("*")) | F.contains(x, F.lit("_"))
    none = F.array().cast(f"array<{RUN}>")
    cells = lambda rows: F.flatten(F.transform(F.filter(F.flatten(rows), marked), cell_runs))
    runs = F.when(code == "T", let(table_cell_texts(lines), cells)).otherwise(F.coalesce(inline_runs(flowing_text(code, lines)), none))
    return run_counts_of(F.when((F.contains(F.lit("TPBxNy"), code)) & F.exists(lines, marked), runs).otherwise(none))


def run_counts_of(runs: Column) -> Column:
    """``struct<bold, italic>`` counts of a run array."""
    return let(
        runs,
        lambda r: F.struct(
            F.size(F.filter(r, lambda x: x["bold"])).alias("bold"),
            F.size(F.filter(r, lambda x: x["italic"])).alias("italic"),
        ),
    )
