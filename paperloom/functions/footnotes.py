"""Footnote definitions and references inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import lexer as L
from .text import group, let, strip, strip_bound


def definitions(text: Column, caret: bool = False) -> Column:
    """``array<struct<num, text, line_no>>`` in line order, duplicates kept.

    ``N. text`` lines count after a line with a reference keyword, until the
    first other line that is not blank.
    """
    pattern = r"(?Ud)^(?:\[\^(\d+)\]:|(\d+)[\\.])\s+(.+)$" if caret else K.FOOTNOTE_DEF

    def scan(lines: Column) -> Column:
        # no region starts before the first line with a keyword
        first = F.greatest(L.frontmatter_length(lines), L.lines_before_keyword(text))
        return let(first, lambda skipped: _regions(lines, skipped, pattern, caret))

    return F.when(
        L.has_keyword(text), let(L.split_lines(text), scan)
    ).otherwise(F.array().cast("array<struct<num:int,text:string,line_no:int>>"))


def _regions(lines: Column, fm: Column, pattern: str, caret: bool) -> Column:
    body = F.slice(lines, fm + 1, F.greatest(F.size(lines) - fm, F.lit(0)))

    def cls(x: Column) -> Column:
        return let(
            strip_bound(x),
            lambda s: F.when(L.has_keyword(s), F.lit("K"))
            .when(s == "", F.lit("E"))
            .when(s.rlike(pattern), F.lit("D"))
            .otherwise(F.lit("O")),
        )

    # lower-case every definition that lies outside a region, keep the others
    classes = F.array_join(F.transform(body, cls), "")
    active = F.regexp_replace(
        F.regexp_replace(classes, F.lit("K[KDE]*"), F.lit(f"{K.CUT}$0{K.CUT}")), F.lit(K.CUT), F.lit("|")
    )
    flags = F.flatten(
        F.transform(
            F.split(active, r"\|", -1),
            lambda p, i: F.transform(
                F.filter(F.split(p, ""), lambda ch: ch != ""), lambda ch: (ch == "D") & (i % 2 == 1)
            ),
        )
    )
    number = lambda s: (F.coalesce(F.nullif(group(s, pattern, 1), F.lit("")), group(s, pattern, 2)) if caret else group(s, pattern, 1))
    rows = F.zip_with(
        F.transform(body, lambda x, i: F.struct(strip_bound(x).alias("s"), (i + fm).cast("int").alias("line_no"))),
        flags,
        lambda x, f: F.struct(x["s"].alias("s"), x["line_no"].alias("line_no"), f.alias("f")),
    )
    return F.transform(
        F.filter(rows, lambda r: r["f"]),
        lambda r: F.struct(
            number(r["s"]).try_cast("int").alias("num"),
            strip(group(r["s"], pattern, 3 if caret else 2)).alias("text"),
            r["line_no"].alias("line_no"),
        ),
    )


def final_notes(defs: Column) -> Column:
    """Last definition of every number, ordered by number."""
    return F.array_sort(
        F.filter(
            defs,
            lambda d, i: ~F.exists(
                F.slice(defs, i + 2, F.greatest(F.size(defs) - i - 1, F.lit(0))), lambda e: e["num"] == d["num"]
            ),
        )
    )


def inline_references(text: Column) -> Column:
    """Numbers of ``.N`` and ``^N^`` marks in order of appearance."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(K.FOOTNOTE_REF), F.lit(0)),
        lambda m: group(m, r"(?U)(\d+)", 1).try_cast("int"),
    )


def endnotes_text(notes: Column) -> Column:
    return F.when(
        F.size(notes) > 0,
        F.concat(
            F.lit("## Citations\n"),
            F.array_join(
                F.transform(notes, lambda n: F.concat(n["num"].cast("string"), F.lit(". "), n["text"])), "\n"
            ),
            F.lit("\n"),
        ),
    ).otherwise(F.lit(""))
