"""Markdown text of runs, cells and blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import blocks as B
from . import constants as K
from .runs import cell_runs, inline_runs
from .tables import table_texts
from .text import let, strip, sub


#: A text without one of these is one unstyled run with nothing to unescape.
STYLED = r"[*_^~$<\\]"


def render_runs(runs: Column, strip_formatting: bool = False, keep_math: bool = False) -> Column:
    """Bold inside italic inside super- or subscript inside a colour span."""

    def one(r: Column) -> Column:
        def wrap(text: Column, on: Column, mark: str) -> Column:
            m = F.when(on, F.lit(mark)).otherwise(F.lit(""))
            return F.concat(m, text, m)

        text = r["text"]
        if keep_math:
            text = wrap(text, r["is_latex"], "$")
        text = wrap(text, r["bold"], "**")
        text = wrap(text, r["italic"], "*")
        text = wrap(text, r["superscript"], "^")
        text = wrap(text, r["subscript"] & ~r["superscript"], "~")
        return F.when(
            r["color_hex"].isNotNull(),
            F.concat(F.lit('<span style="color:'), r["color_hex"], F.lit('">'), text, F.lit("</span>")),
        ).otherwise(text)

    if strip_formatting:
        return F.array_join(F.transform(runs, lambda r: r["text"]), "")
    return F.array_join(F.transform(runs, one), "")


def render_text(text: Column, runs_of=inline_runs, **style) -> Column:
    """Text through its runs; the plain text where there are none."""
    through = let(
        runs_of(text), lambda r: F.when(F.size(r) > 0, render_runs(r, **style)).otherwise(text)
    )
    # one unstyled run with nothing to unescape is the text itself
    return F.when(text.rlike(STYLED), through).otherwise(text)


def render_heading(level: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), strip(F.replace(text, F.lit("**"), F.lit(""))))


def render_callout(title: Column, text: Column) -> Column:
    body = F.transform(
        F.split(text, "\n", -1),
        lambda x: F.when(strip(x) != "", F.concat(F.lit("> "), x)).otherwise(F.lit(">")),
    )
    return F.concat(F.lit("> **["), title, F.lit("]**\n"), F.array_join(body, "\n"))


def escape_cell(text: Column) -> Column:
    return strip(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def render_table(parts: Column, alignment: bool = True, from_lines: bool = False, **style) -> Column:
    """``from_lines``: the cells are those of Markdown lines, so they are trimmed and hold neither bar nor break."""
    def row(cells: Column) -> Column:
        rendered = F.transform(cells, lambda c: escape_cell(render_text(c, cell_runs, **style)))
        text = F.array_join(rendered, " | ")
        if from_lines:  # without a mark they show as they are
            text = let(F.array_join(cells, " | "), lambda t: F.when(t.rlike(STYLED), F.array_join(rendered, " | ")).otherwise(t))
        return F.concat(F.lit("| "), text, F.lit(" |"))

    def rule(a: Column) -> Column:
        if not alignment:
            return F.lit("---")
        return F.when(a == "center", F.lit(":---:")).when(a == "right", F.lit("---:")).otherwise(F.lit("---"))

    rules = F.concat(
        F.lit("| "), F.array_join(F.transform(parts["alignments"], rule), " | "), F.lit(" |")
    )
    rows = F.transform(parts["rows"], row)
    return F.when(
        F.size(parts["rows"]) > 0,
        F.array_join(
            F.concat(F.slice(rows, F.lit(1), F.lit(1)), F.array(rules), F.slice(rows, F.lit(2), F.size(rows))),
            "\n",
        ),
    ).otherwise(F.lit(""))


def join_path(prefix: str, path: Column) -> Column:
    head = prefix.replace("\\", "/").rstrip("/")
    tail = F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    if not head:
        return tail
    return F.when(tail == "", F.lit(head)).otherwise(F.concat(F.lit(head + "/"), tail))


def render_image(image: Column, prefix: str = "", embed: bool = False) -> Column:
    alt = F.coalesce(F.nullif(image["alt_text"], F.lit("")), F.lit("Image"))
    path = image["path"]
    if prefix:
        path = F.when(path != "", join_path(prefix, path)).otherwise(path)
    linked = F.when(
        path == "", F.concat(F.lit("<!-- Image: "), alt, F.lit(" (path not available) -->"))
    ).otherwise(F.concat(F.lit("!["), alt, F.lit("]("), path, F.lit(")")))
    if not embed:
        return linked
    return F.when(
        image["data"].isNotNull(),
        F.concat(F.lit("!["), alt, F.lit("](data:"), image["mime"], F.lit(";base64,"), image["data"], F.lit(")")),
    ).otherwise(linked)


def render_code(language: Column, text: Column) -> Column:
    return F.concat(F.lit("```"), strip(language), F.lit("\n"), text, F.lit("\n```"))


def render_math(text: Column) -> Column:
    return F.concat(F.lit("$$\n"), text, F.lit("\n$$"))


def render_block(code: Column, lines: Column, options) -> Column:
    """Markdown of one block, without the newline that ends it."""
    style = {"strip_formatting": options.strip_formatting, "keep_math": options.keep_math_delimiters}
    numbered = F.contains(F.lit("Ny"), code)
    marker = F.when(
        numbered, F.concat(F.regexp_extract(B.first_line(lines), K.NUMBERED, 2), F.lit(". "))
    ).otherwise(F.lit("- "))
    lead = F.when(code == "P", F.lit("")).otherwise(
        F.concat(F.repeat(F.lit("  "), B.item_indent(code, lines)), marker)
    )
    text = F.when(code == "P", B.paragraph_text(lines, options.keep_double_space)).otherwise(
        B.item_text(code, lines)
    )
    return (
        F.when(
            F.contains(F.lit("PBxNy"), code),
            F.concat(lead, let(text, lambda t: render_text(t, **style))),
        )
        .when(B.is_heading(code), render_heading(B.heading_level(code), B.heading_text(code, lines)))
        .when(
            code == "T",
            let(table_texts(lines), lambda p: render_table(p, options.table_alignment, from_lines=True, **style)),
        )
        .when(code == "Q", let(B.quote_parts(lines), lambda q: render_callout(q["title"], q["text"])))
        .when(
            F.contains(F.lit("GI"), code),
            let(
                B.image_parts(code, lines),
                lambda i: render_image(i, options.image_path_prefix, options.embed_images_base64),
            ),
        )
        .when(F.contains(F.lit("FD"), code), render_code(B.code_language(lines), B.code_text(lines)))
        .when(F.contains(F.lit("LM"), code), render_math(B.math_text(code, lines)))
        .when(F.contains(F.lit("-="), code), F.lit("---"))
        .otherwise(F.lit(""))
    )


def normalize_markdown(text: Column) -> Column:
    """Right-trim lines, blank lines around tables, math and fences, one final newline."""
    trimmed = sub(text, r"(?m)[ \t]+$")
    # even pieces are outside fences, odd pieces are whole fenced blocks
    pieces = F.split(
        F.regexp_replace(trimmed, F.lit(r"(?s)```[^\n]*\n.*?\n```"), F.lit(f"{K.CUT}$0{K.CUT}")), K.CUT, -1
    )

    def shaped(t: Column) -> Column:
        t = sub(t, r"\|[^\n]+\|\n(?:\|[^\n]+\|\n)*", "\n$0\n")
        return sub(t, r"(?s)\$\$\n.*?\n\$\$", "\n$0\n")

    outside = F.transform(
        pieces,
        lambda p, i: F.when(i % 2 == 0, shaped(p)).otherwise(F.concat(F.lit("\n" + K.PART), p, F.lit(K.PART + "\n"))),
    )
    # squeeze newlines outside fences only, then drop the guards
    joined = F.array_join(outside, "")
    squeezed = F.array_join(
        F.transform(
            F.split(joined, K.PART, -1),
            lambda p, i: F.when(i % 2 == 0, sub(p, r"\n{3,}", "\n\n")).otherwise(p),
        ),
        "",
    )
    return F.concat(strip(squeezed), F.lit("\n"))
