"""Canonical summaries of blocks and documents, for comparing two versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import blocks as B
from . import constants as K
from . import lexer as L
from . import metadata as M
from .runs import block_run_counts
from .tables import table_parts
from .text import group, is_digits, let, normalize_block, normalize_inline, strip

SUMMARY_FIELDS = [
    "type", "text", "level", "language", "row_count", "column_count", "alt_text", "list_depth",
    "numbering_format", "bold_run_count", "italic_run_count", "diagram_type", "box_count", "arrow_count",
]

#: What a record holds besides its blocks.
RECORD_FIELDS = ["title", "subtitle", "company", "extra", "footnote_count"]


def block_summary(code: Column, lines: Column) -> Column:
    """Canonical struct of one block (fields of ``SUMMARY_FIELDS``)."""
    item = F.contains(F.lit("BxNy"), code)
    number = F.contains(F.lit("Ny"), code)
    diagram = code == "D"
    body = B.code_text(lines)
    text = (
        F.when(code == "P", normalize_inline(B.paragraph_text(lines)))
        .when(B.is_heading(code), normalize_inline(B.heading_text(code, lines)))
        .when(item, normalize_inline(B.item_text(code, lines)))
        .when(
            code == "Q",
            let(
                B.quote_parts(lines),
                lambda q: F.btrim(
                    F.concat(normalize_inline(q["title"]), F.lit(": "), normalize_inline(q["text"])), F.lit(": ")
                ),
            ),
        )
        .when(code == "F", normalize_block(body))
        .when(diagram, normalize_inline(F.btrim(group(body, r"(?m)^title:[ \t]*(.*)$", 1), F.lit("\"'"))))
        .when(F.contains(F.lit("LM"), code), normalize_block(B.math_text(code, lines)))
        .when(F.contains(F.lit("-="), code), F.lit("---"))
        .otherwise(F.lit(""))
    )
    shape = F.when(code == "T", let(table_parts(lines), lambda t: F.struct(t["n_rows"].alias("r"), t["n_cols"].alias("c"))))
    digits = is_digits(strip(group(B.first_line(lines), K.NUMBERED, 2)))
    counted = lambda key: F.when(
        diagram, F.size(F.regexp_extract_all(body, F.lit(rf"(?m)^\s*-\s*\{{?\s*{key}\s*:"), F.lit(0)))
    ).otherwise(F.lit(0))
    return let(
        F.struct(block_run_counts(code, lines).alias("runs"), shape.alias("shape")),
        lambda x: F.struct(
            B.block_type(code).alias("type"),
            text.alias("text"),
            B.heading_level(code).alias("level"),
            F.when(code == "F", normalize_inline(B.code_language(lines))).otherwise(F.lit("")).alias("language"),
            x["shape"]["r"].alias("row_count"),
            x["shape"]["c"].alias("column_count"),
            F.when(F.contains(F.lit("GI"), code), normalize_inline(B.image_parts(code, lines)["alt_text"]))
            .otherwise(F.lit("")).alias("alt_text"),
            F.when(item, B.item_indent(code, lines)).alias("list_depth"),
            F.when(F.contains(F.lit("Bx"), code), F.lit("bullet"))
            .when(number & digits, F.lit("decimal")).when(number, F.lit("custom"))
            .otherwise(F.lit("")).alias("numbering_format"),
            x["runs"]["bold"].alias("bold_run_count"),
            x["runs"]["italic"].alias("italic_run_count"),
            F.when(diagram, normalize_inline(F.regexp_replace(B.code_language(lines), F.lit("^diagram:"), F.lit(""))))
            .otherwise(F.lit("")).alias("diagram_type"),
            counted("id").alias("box_count"),
            counted("from").alias("arrow_count"),
        ),
    )


def record_parts(doc: Column, footnote_count: Column, parts: str) -> Column:
    """A record whose ``body`` holds code and lines of each block, not yet summarised.

    ``parts``: "metadata" leaves out notes and blocks, "counts" metadata; "status" and "all" need everything.
    """
    none = F.struct(*(F.lit(None).cast("string").alias(n) for n in ("title", "subtitle", "company")), M.no_pairs().alias("extra"))
    body = lambda d: F.transform(M.body_spans(d), lambda b: F.struct(b["code"].alias("code"), b["lines"].alias("lines")))
    return let(
        none if parts == "counts" else M.inferred_metadata(doc),
        lambda m: F.struct(
            *(m[n].alias(n) for n in ("title", "subtitle", "company", "extra")), footnote_count.alias("footnote_count"),
            (F.array().cast("array<struct<code:string,lines:array<string>>>") if parts == "metadata" else body(doc)).alias("body"),
        ),
    )


def summarised_record(r: Column) -> Column:
    """A record of ``record_parts`` whose ``body`` gives way to the summaries of its ``blocks``."""
    kept = (r[f].alias(f) for f in RECORD_FIELDS)
    return F.struct(*kept, F.transform(r["body"], lambda b: block_summary(b["code"], b["lines"])).alias("blocks"))


def equal_run(x: Column, y: Column) -> Column:
    """How many elements two arrays have in common at their start."""
    differs = F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q))
    at = F.array_position(differs, True).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(differs))


def equal_ends(records: Column) -> Column:
    """``struct<x, y, head, tail>``: both bodies and how many blocks their starts and ends have in common."""
    body = lambda n: F.coalesce(F.get(records, F.lit(n))["body"], F.array())
    with_head = lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), equal_run(c["x"], c["y"]).alias("head"))
    with_tail = lambda c: F.struct(
        c["x"].alias("x"), c["y"].alias("y"), c["head"].alias("head"),
        F.least(F.least(F.size(c["x"]), F.size(c["y"])) - c["head"], equal_run(F.reverse(c["x"]), F.reverse(c["y"]))).alias("tail"),
    )
    return let(let(F.struct(body(0).alias("x"), body(1).alias("y")), with_head), with_tail)


def summarised_pair(records: Column, ends: Column, parts: str) -> Column:
    """``struct<a, b>`` of two records whose ``body`` gives way to ``blocks``.

    Blocks of equal source have equal summaries, so those of the equal ends are computed once, and for "status" not at all:
    there ``blocks`` holds only what lies between the first and the last difference.
    """
    if parts in ("metadata", "counts"):
        summary = lambda b: F.struct(B.block_type(b["code"]).alias("type"))
    else:
        summary = lambda b: block_summary(b["code"], b["lines"])

    def side(n: int, blocks: Column) -> Column:
        r = F.get(records, F.lit(n))
        kept = (r[f].alias(f) for f in RECORD_FIELDS)
        return F.when(r.isNotNull(), F.struct(*kept, blocks.alias("blocks")))

    head, tail = ends["head"], ends["tail"]
    middle = lambda s: F.slice(s, head + 1, F.size(s) - head - tail)
    whole = lambda s: F.concat(F.slice(s[0], F.lit(1), head), s[1], F.slice(s[0], F.size(s[0]) - tail + 1, tail))
    of = F.array(middle(ends["x"]) if parts == "status" else ends["x"], middle(ends["y"]))
    return let(
        F.transform(of, lambda blocks: F.transform(blocks, summary)),
        lambda s: F.struct(side(0, s[0]).alias("a"), side(1, s[1] if parts == "status" else whole(s)).alias("b")),
    )


def moved_blocks(before: Column, after: Column) -> Column:
    """``struct<blocks, told, same_types, types>`` of two documents: how many blocks the first has in its body, whether either
    has any, whether every type keeps its number, and the types of blocks that are not found again at their ``block_idx``.

    Blocks that became metadata are at no place. Blocks of equal source are equal, so only others are summarised.
    """

    def placed(doc: Column) -> Column:
        # equal sources must agree in this too; a block outside the body has no source to compare
        return F.transform(
            doc["spans"],
            lambda b, i: F.when(M.in_body(doc["header"], i, b["code"]), F.struct(b["code"].alias("code"), b["lines"].alias("lines"))),
        )

    def summary(b: Column) -> Column:
        told = lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"))
        return F.when(b.isNotNull(), let(block_summary(b["code"], b["lines"]), told))

    def moved(x: Column, y: Column) -> Column:
        none = F.array().cast("array<string>")
        differ = lambda p: F.when(p["x"].eqNullSafe(p["y"]), none).otherwise(F.array(p["x"]["type"], p["y"]["type"]))
        return F.when(x.eqNullSafe(y), none).otherwise(let(F.struct(summary(x).alias("x"), summary(y).alias("y")), differ))

    def compared(p: Column) -> Column:
        types = lambda codes: F.array_sort(F.transform(codes, B.block_type))
        return let(
            F.struct(*(F.transform(F.filter(p[n], lambda b: b.isNotNull()), lambda b: b["code"]).alias(n) for n in "xy")),
            lambda c: F.struct(
                F.size(c["x"]).alias("blocks"), ((F.size(c["x"]) > 0) | (F.size(c["y"]) > 0)).alias("told"),
                F.when(c["x"] == c["y"], F.lit(True)).otherwise(types(c["x"]) == types(c["y"])).alias("same_types"),
                F.flatten(F.zip_with(p["x"], p["y"], moved)).alias("types"),
            ),
        )

    return let(F.struct(placed(before).alias("x"), placed(after).alias("y")), compared)


def type_counts(blocks: Column) -> Column:
    """``array<struct<type, n>>`` of the block types that occur, by type name."""
    def count(name: str) -> Column:
        n = F.size(F.filter(blocks, lambda b: b["type"] == name))
        return F.struct(F.lit(name).alias("type"), n.alias("n"))

    return F.filter(F.array(*[count(t) for t in sorted(set(L.TYPES.values()))]), lambda c: c["n"] > 0)
