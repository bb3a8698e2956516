"""Office blocks to typed blocks to Markdown, and block ranges.

``spans(doc_id, start_idx, end_idx)`` are ranges of block numbers, the end outside; a null end is the end of the
document. They may overlap, be of any length and lie anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import flow as FL
from ..functions import footnotes as N
from ..functions import office as O
from ..functions import render as R
from ..functions.running import running
from ..functions.text import group, strip
from . import office as W
from .render import assemble_from_blocks

KEY = ["doc_id", "block_idx"]
#: Beyond this block number a range has no end.
_FAR = 1 << 60


# --- ranges ---------------------------------------------------------------------------

def mark_spans(blocks: DataFrame, spans: DataFrame, name: str = "in_span") -> DataFrame:
    """``blocks`` with a flag: whether any span of its document holds the block.

    A sweep instead of a range join: every span adds one where it starts and takes one away where it ends, equal places
    are summed up first, and a block is held where the running sum is above zero. So many overlapping spans, one over a
    whole document or a document with most of all blocks cost no more than their rows; sums are carried over chunks.
    Empty spans (the end not behind the start) hold nothing, neither do spans or blocks without a document.
    """
    real = spans.filter("doc_id IS NOT NULL AND start_idx IS NOT NULL AND (end_idx IS NULL OR end_idx > start_idx)")
    start, end = F.least("start_idx", F.lit(_FAR)).cast("long"), F.col("end_idx").cast("long")
    change = F.array(
        F.struct(start.alias("at"), F.lit(1).alias("by")), F.when(end < _FAR, F.struct(end.alias("at"), F.lit(-1).alias("by")))
    )
    steps = real.select("doc_id", F.explode(change).alias("x")).filter("x IS NOT NULL")
    steps = steps.groupBy("doc_id", "x.at").agg(F.sum("x.by").alias("_by")).filter("_by <> 0")
    # what changes at a block's number comes before the block
    rows = blocks.filter("doc_id IS NOT NULL").withColumns({"_at": 2 * F.col("block_idx").cast("long") + 1, "_by": F.lit(0).cast("long")})
    swept = running(
        rows.unionByName(steps.select("doc_id", (2 * F.col("at")).alias("_at"), "_by"), allowMissingColumns=True), ["doc_id"], "_at", sums={"_held": F.col("_by")},
        chunk=2 * W.CHUNK,
    )
    marked = swept.filter(F.col("_at") % 2 != 0).select(*blocks.columns, (F.col("_held") > 0).alias(name))
    return marked.unionByName(blocks.filter("doc_id IS NULL").select("*", F.lit(False).alias(name)))


def drop_spans(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks that no span of their document holds."""
    return mark_spans(blocks, spans, "_in_span").filter("NOT _in_span").drop("_in_span")


def keep_spans(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks that a span of their document holds, once."""
    return mark_spans(blocks, spans, "_in_span").filter("_in_span").drop("_in_span")


def boilerplate_spans(marks: DataFrame, profiles: DataFrame) -> DataFrame:
    """What ``drop_boilerplate`` skips, as spans: cover, contents, notes and disclaimer of generated documents."""
    m = marks.join(profiles.filter("profile = 'GENERATED'").select("doc_id"), "doc_id")
    cover = F.when(F.col("cover_note") >= F.col("panel"), F.col("cover_note")).otherwise(F.col("panel"))
    before = F.when(F.col("disclaimer") >= F.col("notes"), F.col("disclaimer"))
    of = lambda start, end: F.struct(start.cast("long").alias("start_idx"), end.cast("long").alias("end_idx"))
    found = F.array(
        F.when(cover.isNotNull(), of(F.lit(0), cover + 1)), F.when(F.col("toc").isNotNull(), of(F.col("toc"), F.col("toc") + 1)),
        F.when(F.col("field_kind") == "p", of(F.col("field"), F.col("toc_stop"))),
        F.when(F.col("notes").isNotNull(), of(F.col("notes"), before)), F.when(F.col("disclaimer").isNotNull(), of(F.col("disclaimer"), F.lit(None))),
    )
    return m.select("doc_id", F.inline(F.filter(found, lambda x: x.isNotNull())))


# --- typed blocks -----------------------------------------------------------------------

def _typed(blocks: DataFrame, styles: DataFrame, numbering: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with ``type, level, title, language, body`` and what list numbers need; the type is null where nothing is said."""
    formats = W.looked_up(numbering, levels, [*keys, "abstract_id"]).select(*keys, "num_id", F.col("ilvl").alias("_lvl"), "num_fmt")
    rows = blocks.withColumn("_lvl", F.coalesce("ilvl", F.lit(0)))
    for facts in (styles.select(*keys, "style_id", "name"), W.style_levels(styles, keys)):
        rows = W.looked_up(rows, facts, [*keys, "style_id"])
    rows = W.looked_up(rows, formats, [*keys, "num_id", "_lvl"])
    rows = rows.withColumns({
        "mark": O.bookmark_parts(F.col("bookmark")), "heading": W.heading_of(), "list_type": W.list_type_of(), "list_level": W.list_level_of(),
        "stripped": strip(F.col("text")), "fact_title": O.callout_title(strip(F.col("text")), F.col("fill")),
    })
    para, text = F.col("kind") == "p", F.col("stripped")
    one_cell = (F.col("kind") == "t") & (F.col("n_rows") == 1) & (F.col("n_cols") == 1) & (text != "")
    math = text.rlike(r"(?s)^\$\$.+?\$\$$")
    kind = (
        F.when(para & F.col("mark.type").isin(*MARKED), F.element_at(F.create_map(*(F.lit(x) for kv in MARKED.items() for x in kv)), F.col("mark.type")))
        .when(one_cell & (F.col("mark.type") == "CODE_BLOCK"), "code")
        .when(one_cell & F.col("fact_title").isNotNull(), "callout")
        .when(~para, "table")
        .when(text == "", F.lit(None))
        .when(math, "math")
        .when(F.col("heading") > 0, "heading")
        .otherwise(F.coalesce("list_type", F.lit("paragraph")))
    )
    rows = rows.withColumn("type", kind)
    body = (
        F.when(F.col("type") == "callout", O.callout_body(text, F.col("fact_title")))
        .when(F.col("type") == "code", F.regexp_replace(F.col("text"), r"^\n+|\n+$", ""))
        .when(F.col("type") == "math", strip(group(text, r"(?s)^\$\$(.+?)\$\$$", 1)))
        .when(F.col("type") == "bullet", F.coalesce(F.nullif(group(text, K.BULLET_TEXT, 1), F.lit("")), text))
        .when((F.col("type") == "number") & text.rlike(K.NUMBERED_TEXT), group(text, K.NUMBERED_TEXT, 2))
        .otherwise(text)
    )
    return rows.withColumns({
        "level": F.when(F.col("type") == "heading", F.col("heading")).when(F.col("type").isin("bullet", "number"), F.col("list_level")),
        "title": F.when(F.col("type") == "callout", F.col("fact_title")),
        "language": F.when(F.col("type").isin("code", "diagram"), F.coalesce("mark.extra", F.lit(""))),
        "visible": F.when((F.col("type") == "number") & text.rlike(K.NUMBERED_TEXT), group(text, K.NUMBERED_TEXT, 1)),
        "list_key": W.list_key(F.col("num_id"), F.col("style_id"), F.col("name"), F.col("list_level")), "body": body,
    })


#: Bookmark types and the block types that they stand for.
MARKED = {"SEPARATOR": "separator", "CODE_BLOCK": "code", "DIAGRAM": "diagram"}


def office_to_blocks(
    blocks: DataFrame, styles: DataFrame, numbering: DataFrame, numbering_levels: DataFrame,
    spans: DataFrame | None = None, scope: list[str] | None = None,
) -> DataFrame:
    """``(doc_id, block_idx, source_idx, type, level, number, title, language, text)``.

    All facts of a block are found in its row (lookups are joined, of bounded size by broadcast). Then one ordered fold
    per document, in chunks of ``CHUNK`` positions, numbers the blocks that say something from 0 without gaps and counts
    list items that have no visible number; blocks in ``spans`` are left out and end every list. ``level`` is a heading's or
    a list item's (from 0).
    """
    keys, kept = scope or [], mark_spans(blocks, spans, "skipped") if spans is not None else blocks.withColumn("skipped", F.lit(False))
    typed = _typed(kept, styles, numbering, numbering_levels, keys)
    emits = ~F.col("skipped") & F.col("type").isNotNull()
    counts = emits & (F.col("type") == "number") & F.col("visible").isNull()
    rows = typed.select(
        "doc_id", F.floor(F.col("block_idx") / W.CHUNK).alias("chunk"), F.col("block_idx").alias("source_idx"), F.col("skipped").alias("is_break"),
        F.coalesce(emits, F.lit(False)).alias("emits"), F.coalesce(counts, F.lit(False)).alias("counts"), "list_key", "list_level", "num_fmt",
        "type", "level", "title", "language", "visible", "body",
    ).filter("is_break OR emits").repartition("doc_id", "chunk")
    order, doc = ["doc_id", "chunk", "source_idx"], f"doc_id {dict(blocks.dtypes)['doc_id']}"
    # the summaries read the same rows as the fold, all columns, so that one shuffle serves both
    summed = rows.sortWithinPartitions(*order).mapInArrow(FL.summaries, f"{doc}, chunk long, summary string")
    starts = summed.repartition("doc_id").sortWithinPartitions("doc_id", "chunk").mapInArrow(FL.carried, f"{doc}, chunk long, start string")
    started = rows.join(starts, ["doc_id", "chunk"]).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in started.schema)
    out = started.mapInArrow(FL.placed, f"{schema}, place long, parts array<struct<value: long, fmt: string>>")
    number = F.array_join(F.transform("parts", lambda p: O.number_label(p["value"], p["fmt"])), ".")
    return out.select(
        "doc_id", F.col("place").alias("block_idx"), "source_idx", "type", "level", F.coalesce("visible", number).alias("number"), "title", "language", F.col("body").alias("text")
    )


# --- Markdown ------------------------------------------------------------------------------

def _tables(cells: DataFrame) -> DataFrame:
    """``(doc_id, source_idx, parts)``: rows and column alignments of every table; one table is one row."""
    align = F.col("align") if "align" in cells.columns else F.lit(None).cast("string")
    # columns without a vote are on the left
    rows = cells.withColumn("_align", align).groupBy("doc_id", "block_idx", "row_idx").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", F.coalesce("text", F.lit("")).alias("text"), "_align"))).alias("c")
    )
    tables = rows.groupBy("doc_id", "block_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", "c"))).alias("r"))
    texts = F.transform("r", lambda r: F.transform(r["c"], lambda c: c["text"]))
    width = F.array_max(F.transform("r", lambda r: F.size(r["c"])))

    def vote(i: Column) -> Column:
        has = lambda side: F.exists("r", lambda r: F.get(r["c"], i)["_align"] == side)
        return F.when(has("right"), "right").when(has("center"), "center").otherwise("left")

    alignments = F.transform(F.sequence(F.lit(0), width - 1), vote)
    return tables.select("doc_id", F.col("block_idx").alias("source_idx"), F.struct(texts.alias("rows"), alignments.alias("alignments")).alias("parts"))


def typed_markdown() -> Column:
    """Markdown of typed blocks; tables are rendered from their ``parts``."""
    text, kind = F.col("text"), F.col("type")
    indent = F.repeat(F.lit("  "), F.coalesce("level", F.lit(0)))
    return (
        F.when(kind == "heading", R.render_heading(F.col("level"), text))
        .when(kind == "bullet", F.concat(indent, F.lit("- "), text))
        .when(kind == "number", F.concat(indent, F.col("number"), F.lit(". "), text))
        .when(kind == "callout", R.render_callout(F.col("title"), text))
        .when(kind == "code", R.render_code(F.col("language"), text))
        .when(kind == "diagram", R.render_code(F.lit("diagram"), text))
        .when(kind == "math", R.render_math(text))
        .when(kind == "separator", F.lit("---"))
        .when(kind == "table", F.when(F.col("parts").isNotNull(), R.render_table(F.col("parts"))).otherwise(text))
        .otherwise(text)
    )


def office_to_markdown(
    typed: DataFrame, cells: DataFrame | None = None, notes: DataFrame | None = None, front: DataFrame | None = None
) -> DataFrame:
    """One Markdown text per document ``(doc_id, markdown)`` from ``office_to_blocks``.

    ``cells`` are those of the tables, ``notes(doc_id, num, text)`` become the end notes, ``front(doc_id, frontmatter)`` the
    metadata block. Blocks of one chunk are joined before they meet the other chunks of their document.
    """
    rows = typed.withColumn("parts", F.lit(None).cast("struct<rows: array<array<string>>, alignments: array<string>>"))
    if cells is not None:
        rows = typed.join(_tables(cells), ["doc_id", "source_idx"], "left")
    said = rows.select("doc_id", "block_idx", typed_markdown().alias("markdown")).filter("markdown <> ''")
    chunks = said.groupBy("doc_id", F.floor(F.col("block_idx") / W.CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("block_idx", "markdown"))).alias("b"))
    joined = chunks.select("doc_id", F.col("chunk").alias("block_idx"), F.array_join(F.transform("b", lambda x: x["markdown"]), "\n\n").alias("markdown"))
    ends = None
    if notes is not None:
        listed = notes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("num", "text"))).alias("n"))  # one document's notes
        ends = listed.select("doc_id", N.endnotes_text(F.col("n")).alias("endnotes"))
    return assemble_from_blocks(joined, front, ends)
