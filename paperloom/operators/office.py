"""Office-derived block tables: styles, lists, numbering, boilerplate, metadata.

``office_blocks(doc_id, block_idx, kind, text, style_id, num_id, ilvl,
left_indent_pt, all_bold, outline_lvl, n_rows, n_cols, fill, bookmark)``;
``kind`` is ``p`` (paragraph) or ``t`` (table).  Lookup tables (styles, numbering,
theme) are joined by key; their size is the caller's. Styles and list levels are
counted first and broadcast up to ``MAX_LOOKUP_ROWS``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import numbering as N
from ..functions import office as O
from ..functions.text import group, is_digits, rstrip, lstrip, strip

CHUNK = 4096
KEY = ["doc_id", "block_idx"]
#: Rows up to which a table of styles or list levels is broadcast; a larger one is joined as the optimizer sees fit.
MAX_LOOKUP_ROWS = 100_000


def looked_up(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a lookup table, by broadcast if it has been counted to be small."""
    small = facts.limit(MAX_LOOKUP_ROWS + 1).count() <= MAX_LOOKUP_ROWS
    return rows.join(F.broadcast(facts) if small else facts, on, "left")


# --- styles and headings --------------------------------------------------------

def style_levels(styles: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Heading level of every style from the nearest style of its base chain.

    The styles of a scope (one document or package) become arrays. In them every
    round looks twice as far along the chain, so the number of rounds is the
    logarithm of the number of styles; cycles end there.
    """
    keys = scope or []
    own = F.coalesce(
        O.heading_hint(F.col("name")), O.heading_hint(F.col("style_id")), F.col("outline_lvl") + 1
    )
    rows = F.struct("style_id", own.alias("level"), F.col("base_style_id").alias("base"))
    sets = styles.groupBy(*keys).agg(F.array_sort(F.collect_list(rows)).alias("s"))
    ids = F.col("s.style_id")
    start = F.struct(
        F.col("s.level").alias("level"),
        F.transform("s.base", lambda b: F.nullif(F.array_position(ids, b), F.lit(0)).cast("int")).alias("next"),
    )

    def look(values: Column, at: Column) -> Column:
        return F.when(at.isNotNull(), F.get(values, at - 1))

    def step(state: Column, _: Column) -> Column:
        level = F.transform(
            state["next"], lambda n, i: F.coalesce(F.get(state["level"], i), look(state["level"], n))
        )
        further = F.transform(state["next"], lambda n: look(state["next"], n))
        return F.struct(level.alias("level"), further.alias("next"))

    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size("s") + 1)).cast("int")))
    levels = F.aggregate(rounds, start, step)["level"]
    found = F.explode(F.arrays_zip(ids.alias("style_id"), levels.alias("level")))
    return sets.select(*keys, found.alias("x")).select(*keys, F.col("x.style_id"), F.col("x.level").alias("level"))


def style_levels_stored(styles: DataFrame, folder: str, scope: list[str] | None = None) -> DataFrame:
    """As ``style_levels``, for relations of any size: pointer doubling by joins.

    Every round joins the styles that still have a pointer with the style that it shows to, takes its level if they have
    none, and moves the pointer to where that one points, so chains of n styles take log2(n) rounds and no row is larger than
    a style. A pointer ends at a level, at the end of a chain or, in a cycle, with the last round, which the largest scope
    decides: no chain without a cycle is longer. Styles in or before a cycle without a level have none. A style without a
    pointer is settled and stays where it was written; of these, only those with a level are read again by later rounds. Rounds are written to ``folder``, which all executors must share. Scope columns must not be null; of
    equal style ids in a scope the one with the least level counts.
    """
    keys = [*(scope or []), "style_id"]
    spark = styles.sparkSession
    own = F.coalesce(O.heading_hint(F.col("name")), O.heading_hint(F.col("style_id")), F.col("outline_lvl") + 1)
    rows = styles.filter("style_id IS NOT NULL").groupBy(*keys).agg(F.min(F.struct(own.isNull().alias("none"), own.alias("level"), F.col("base_style_id").alias("next"))).alias("s"))
    state = rows.select(*keys, "s.level", F.when(F.col("s.level").isNull(), F.col("s.next")).alias("next"))
    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    written = [put(state, "round=0")]
    largest = written[0].groupBy(*(scope or [])).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    steps = 1  # hops that a pointer stands for
    while True:
        open_now = written[-1].filter("next IS NOT NULL")
        if steps >= largest or open_now.isEmpty():
            return reduce(DataFrame.unionByName, [*(w.filter("next IS NULL") for w in written[:-1]), written[-1]]).select(*keys, "level")
        settled = [w.filter("next IS NULL AND level IS NOT NULL") for w in written]
        base = reduce(DataFrame.unionByName, [open_now, *settled]).select(*(scope or []), F.col("style_id").alias("next"), F.col("level").alias("_level"), F.col("next").alias("_next"))
        joined = open_now.join(base, [*(scope or []), "next"], "left")
        written.append(put(joined.select(*keys, F.col("_level").alias("level"), F.when(F.col("_level").isNull(), F.col("_next")).alias("next")), f"round={len(written)}"))
        steps *= 2


def heading_level(blocks: DataFrame, levels: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Style level, else paragraph outline, else level 2 for short all-bold text."""
    joined = looked_up(blocks, levels, [*(scope or []), "style_id"])
    return joined.select(*KEY, heading_of().alias("heading_level"))


def heading_of() -> Column:
    """Heading level of blocks that carry the ``level`` of their style."""
    text = strip(F.col("text"))
    bold = F.col("all_bold") & (text != "") & (F.length(text) <= 80) & ~text.endswith(".")
    return F.coalesce(F.col("level"), F.col("outline_lvl") + 1, F.when(bold, F.lit(2)))


# --- lists ------------------------------------------------------------------------

def numbering_format(
    blocks: DataFrame, numbering: DataFrame, levels: DataFrame, scope: list[str] | None = None
) -> DataFrame:
    """Blocks with ``num_fmt`` from num id -> abstract id -> level."""
    keys = scope or []
    fmt = looked_up(numbering, levels, [*keys, "abstract_id"]).select(
        *keys, "num_id", F.col("ilvl").alias("_lvl"), "num_fmt"
    )
    at = blocks.withColumn("_lvl", F.coalesce("ilvl", F.lit(0)))
    return looked_up(at, fmt, [*keys, "num_id", "_lvl"]).drop("_lvl")


def _named(blocks: DataFrame, styles: DataFrame, scope: list[str] | None) -> DataFrame:
    keys = [*(scope or []), "style_id"]
    return looked_up(blocks, styles.select(*keys, "name"), keys)


def list_type(blocks: DataFrame, styles: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``(doc_id, block_idx, list_type)``: ``bullet`` / ``number`` / null of blocks that carry ``num_fmt``."""
    return with_list_type(blocks, styles, scope).select(*KEY, "list_type")


def with_list_type(blocks: DataFrame, styles: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``blocks`` with ``list_type``."""
    return _named(blocks, styles, scope).select(*blocks.columns, list_type_of().alias("list_type"))


def list_type_of() -> Column:
    """List type of blocks that carry ``num_fmt`` and the ``name`` of their style."""
    text = strip(F.col("text"))
    name = F.coalesce("name", F.lit(""))
    return F.coalesce(
        F.when(F.col("num_fmt").isNotNull(), F.when(F.col("num_fmt") == "bullet", "bullet").otherwise("number")),
        F.when(F.col("style_id").isin(*K.BULLET_STYLE_IDS), "bullet"),
        F.when(F.col("style_id").isin(*K.NUMBER_STYLE_IDS), "number"),
        F.when(name.rlike(K.BULLET_STYLE_NAME), "bullet"),
        F.when(name.rlike(K.NUMBER_STYLE_NAME), "number"),
        F.when(text.rlike(K.BULLET_TEXT), "bullet"),
        F.when(text.rlike(K.NUMBERED_TEXT), "number"),
    )


def list_level(blocks: DataFrame, styles: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return with_list_level(blocks, styles, scope).select(*KEY, "list_level")


def with_list_level(blocks: DataFrame, styles: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``blocks`` with ``list_level``."""
    return _named(blocks, styles, scope).select(*blocks.columns, list_level_of().alias("list_level"))


def list_level_of() -> Column:
    """List level of blocks that carry the ``name`` of their style."""
    name = F.coalesce("name", F.lit(""))
    indent = F.col("left_indent_pt")
    return F.coalesce(
        F.col("ilvl").cast("int"),
        F.when(name.rlike(r"(?U)\d+$"), F.greatest(F.lit(0), group(name, r"(?U)(\d+)$", 1).try_cast("int") - 1)),
        F.when(indent != 0, F.greatest(F.lit(0), (F.bround(F.greatest(F.lit(0.0), indent) / 18.0, 0) - 1).cast("int"))),
        F.lit(0),
    )


def list_key(num_id: Column, style_id: Column, style_name: Column, level: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("num:"), num_id),
        F.concat(F.lit("style-id:"), F.nullif(style_id, F.lit(""))),
        F.concat(F.lit("style-name:"), F.coalesce(style_name, F.lit("generic")), F.lit(":level:"), level.cast("string")),
    )


def hierarchical_numbers(items: DataFrame) -> DataFrame:
    """Labels like ``2.b.iii`` of list items without a visible number, at any depth.

    Input ``(doc_id, block_idx, list_key, level, num_fmt, is_break)``; break rows
    end every list of the document and get no label.  A shallower item resets
    the deeper counters of its list.  Rows are folded in chunks of ``CHUNK``
    positions, so that one document is many tasks; one summary per chunk is
    carried over.
    """
    ids = dict(items.dtypes)
    doc = f"doc_id {ids['doc_id']}"
    chunked = items.select(
        "doc_id", F.floor(F.col("block_idx") / CHUNK).alias("chunk"), "block_idx", "list_key", "level", "num_fmt", "is_break"
    ).repartition("doc_id", "chunk")
    order = ["doc_id", "chunk", "block_idx"]
    summed = chunked.sortWithinPartitions(*order).mapInPandas(N.summaries, f"{doc}, chunk long, summary string")
    starts = summed.repartition("doc_id").sortWithinPartitions("doc_id", "chunk").mapInPandas(
        N.carried, f"{doc}, chunk long, start string"
    )
    started = chunked.join(starts, ["doc_id", "chunk"], "left").sortWithinPartitions(*order)
    parts = started.mapInPandas(
        N.numbered, f"{doc}, block_idx {ids['block_idx']}, parts array<struct<value: long, fmt: string>>"
    )
    return parts.select(
        *KEY, F.array_join(F.transform("parts", lambda p: O.number_label(p["value"], p["fmt"])), ".").alias("number")
    )


# --- profile and boilerplate -----------------------------------------------------------

def table_signals(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Tables that look like a generated metadata panel or cover disclaimer."""
    labels = (
        cells.filter((F.col("col_idx") == 0) & F.upper(strip(F.col("text"))).isin(*K.PANEL_LABELS))
        .groupBy(*KEY)
        .agg(F.size(F.collect_set(F.upper(strip(F.col("text"))))).alias("labels"))  # of a fixed list of labels
    )
    tables = blocks.filter("kind = 't'").select(*KEY, "n_cols", "n_rows", "text").join(labels, KEY, "left")
    panel = (F.col("n_cols") == 2) & (F.col("n_rows") >= 3) & (F.coalesce("labels", F.lit(0)) >= 3)
    note = (F.col("n_cols") == 1) & (F.col("n_rows") == 1) & F.contains("text", F.lit(K.DISCLAIMER_TEXT))
    return tables.select(*KEY, panel.alias("is_panel"), (note & ~panel).alias("is_disclaimer"))


def document_profile(
    blocks: DataFrame, signals: DataFrame, props: DataFrame, generator: str
) -> DataFrame:
    """``GENERATED`` by property, by two structural signals, or by one plus one title line."""
    none = F.lit(None)
    facts = (
        blocks.select(
            "doc_id",
            ((F.col("kind") == "p") & strip(F.col("text")).isin(K.TOC_TITLE, K.ENDNOTES_TITLE, K.DISCLAIMER_TITLE)).alias("title"),
            none.cast("boolean").alias("signal"), none.cast("boolean").alias("named"),
        )
        .unionByName(signals.select("doc_id", none.cast("boolean").alias("title"), (F.col("is_panel") | F.col("is_disclaimer")).alias("signal"), none.cast("boolean").alias("named")))
        .unionByName(
            props.filter((F.lower(strip(F.col("value"))) == generator.lower()) & (F.col("name") == "generator"))
            .select("doc_id", none.cast("boolean").alias("title"), none.cast("boolean").alias("signal"), F.lit(True).alias("named"))
        )
    )
    counted = facts.groupBy("doc_id").agg(
        F.count_if("title").alias("t"), F.count_if("signal").alias("s"), F.count_if("named").alias("named"),
        F.count_if(F.col("title").isNotNull()).alias("blocks"),
    ).filter("blocks > 0")
    generated = (F.col("named") > 0) | (F.col("s") >= 2) | ((F.col("s") >= 1) & (F.col("t") >= 1))
    return counted.select("doc_id", F.when(generated, "GENERATED").otherwise("GENERIC").alias("profile"))


def document_marks(blocks: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per document: where panel, cover note, contents, notes and disclaimer start."""
    def first(flag: Column) -> Column:
        return F.min(F.when(flag, F.col("block_idx")))

    text = strip(F.col("text"))
    para = F.col("kind") == "p"
    no = F.lit(False)
    rows = blocks.select("doc_id", "block_idx", "kind", "text", no.alias("is_panel"), no.alias("is_disclaimer")).unionByName(
        signals.select("doc_id", "block_idx", F.lit("signal").alias("kind"), F.lit(None).cast("string").alias("text"), "is_panel", "is_disclaimer")
    )
    return rows.groupBy("doc_id").agg(
        first(F.col("is_panel")).alias("panel"),
        first(F.col("is_disclaimer")).alias("cover_note"),
        first(para & (text == K.TOC_TITLE)).alias("toc"),
        first(para & (text == K.ENDNOTES_TITLE)).alias("notes"),
        first(para & (text == K.DISCLAIMER_TITLE)).alias("disclaimer"),
    )


def boilerplate_marks(blocks: DataFrame, signals: DataFrame, styles: DataFrame) -> DataFrame:
    """``document_marks`` and where the contents end."""
    text, marks = strip(F.col("text")), document_marks(blocks, signals)
    # contents: the next paragraph always, then lines that look like contents
    after = blocks.join(marks.filter("toc is not null").select("doc_id", "toc"), "doc_id").filter("block_idx > toc")
    nexts = after.groupBy("doc_id", "toc").agg(F.min(F.struct("block_idx", "kind")).alias("n"))
    field = nexts.select("doc_id", F.col("n.block_idx").alias("field"), F.col("n.kind").alias("field_kind"))
    named = after.join(styles.select("style_id", "name"), "style_id", "left").join(field, "doc_id")
    toc_like = (F.col("kind") == "p") & (
        ((text == "") & ~F.coalesce(F.col("has_object"), F.lit(False)))
        | F.upper(F.coalesce("name", F.lit(""))).startswith("TOC")
        | F.contains(text, F.lit(K.TOC_NOTE))
    )
    stops = named.filter((F.col("block_idx") > F.col("field")) & ~toc_like).groupBy("doc_id").agg(
        F.min("block_idx").alias("toc_stop")
    )
    return marks.join(field, "doc_id", "left").join(stops, "doc_id", "left")


def is_boilerplate() -> Column:
    """True for blocks (joined with their marks) that a generated document repeats."""
    i = F.col("block_idx")
    cover_end = F.when(F.col("cover_note") >= F.col("panel"), F.col("cover_note")).otherwise(F.col("panel"))
    in_cover = i <= cover_end
    in_toc = (i == F.col("toc")) | (
        (F.col("field_kind") == "p") & (i >= F.col("field"))
        & (F.col("toc_stop").isNull() | (i < F.col("toc_stop")))
    )
    no_end = F.col("disclaimer").isNull() | (F.col("disclaimer") < F.col("notes"))
    in_notes = (i >= F.col("notes")) & (no_end | (i < F.col("disclaimer")))
    return (
        F.coalesce(in_cover, F.lit(False)) | F.coalesce(in_toc, F.lit(False))
        | F.coalesce(in_notes, F.lit(False)) | F.coalesce(i >= F.col("disclaimer"), F.lit(False))
    )


def drop_boilerplate(blocks: DataFrame, marks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Blocks with ``is_skipped``; only generated documents lose blocks."""
    generated = profiles.filter("profile = 'GENERATED'").join(marks, "doc_id")
    return blocks.join(generated, "doc_id", "left").withColumn(
        "is_skipped", F.col("profile").isNotNull() & is_boilerplate()
    ).select(*blocks.columns, "is_skipped")


def endnote_rows(blocks: DataFrame, runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Notes of the end-note section: ``(doc_id, num, text)``; the last of equal numbers wins."""
    spans = marks.filter("notes is not null").select("doc_id", "notes", "disclaimer")
    inside = blocks.filter("kind = 'p'").join(spans, "doc_id").filter(
        (F.col("block_idx") > F.col("notes"))
        & (F.col("disclaimer").isNull() | (F.col("disclaimer") < F.col("notes")) | (F.col("block_idx") < F.col("disclaimer")))
    )
    shown = runs.filter(F.col("text") != "").join(inside.select(*KEY), KEY, "left_semi")
    # runs of one paragraph only
    notes = shown.groupBy(*KEY).agg(
        F.min_by(F.struct("text", "superscript"), F.when(strip(F.col("text")) != "", F.col("run_idx"))).alias("head"),
        F.array_sort(F.collect_list(F.struct("run_idx", "text"))).alias("r"),
    )
    number = strip(F.col("head.text"))
    rest = strip(
        F.array_join(F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: x["text"]), "")
    )
    found = notes.filter(F.col("head.superscript") & is_digits(number)).select(
        "doc_id", "block_idx", number.try_cast("int").alias("num"), rest.alias("text")
    )
    return found.groupBy("doc_id", "num").agg(F.max_by("text", "block_idx").alias("text"))


# --- metadata ---------------------------------------------------------------------------

def property_metadata(props: DataFrame) -> DataFrame:
    """Custom properties as entries: known keys fill fields (last wins), others ``extra`` (first wins)."""
    key = O.property_key(F.col("name"))
    field = F.element_at(F.create_map(*[F.lit(x) for kv in K.PROPERTY_FIELDS.items() for x in kv]), key)
    rows = props.select("doc_id", "ord", "value", key.alias("raw"), field.alias("field"))
    entries = rows.groupBy("doc_id", F.coalesce("field", "raw").alias("key")).agg(
        F.max_by("value", F.when(F.col("field").isNotNull(), F.col("ord"))).alias("last"),
        F.min_by("value", "ord").alias("first"),
    )
    return entries.select("doc_id", "key", F.coalesce("last", "first").alias("value"))


def panel_values(cells: DataFrame, marks: DataFrame) -> DataFrame:
    """Label / value rows of the metadata panel; the last of equal labels wins."""
    panel = cells.join(
        marks.filter("panel is not null").select("doc_id", F.col("panel").alias("block_idx")), KEY, "left_semi"
    )
    rows = panel.groupBy(*KEY, "row_idx").agg(
        F.max(F.when(F.col("col_idx") == 0, F.upper(strip(F.col("text"))))).alias("label"),
        F.max(F.when(F.col("col_idx") == 1, strip(F.col("text")))).alias("value"),
    ).filter("label <> '' and value <> ''")
    return rows.groupBy("doc_id", "label").agg(F.max_by("value", "row_idx").alias("value"))


def cover_metadata(blocks: DataFrame, cells: DataFrame, marks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Report type, identity, title and subtitle read from the cover lines, with the panel's company and sector.

    Where the panel has no company or sector, those of ``known`` ``(doc_id, company, sector)`` count.  The identity is
    the ticker if there is a company and it is not its name.
    """
    panel = panel_values(cells, marks).groupBy("doc_id").agg(
        F.max(F.when(F.col("label") == "INSTITUTION", F.col("value"))).alias("company"),
        F.max(F.when(F.col("label") == "SECTOR", F.col("value"))).alias("sector"),
    )
    # the lines of one cover
    cover = (
        blocks.filter("kind = 'p'").select("doc_id", "block_idx", strip(F.col("text")).alias("text"))
        .join(marks.filter("panel is not null").select("doc_id", "panel"), "doc_id")
        .filter("block_idx < panel and text <> ''")
        .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "text"))).alias("lines"))
        .join(panel, "doc_id", "left")
    )
    if known is None:
        cover = cover.withColumn("own_company", F.lit("")).withColumn("own_sector", F.lit(""))
    else:
        own = known.select("doc_id", F.col("company").alias("own_company"), F.col("sector").alias("own_sector"))
        cover = cover.join(own, "doc_id", "left")
    text = lambda line: F.coalesce(line["text"], F.lit(""))
    first = lambda lines: F.get(lines, F.lit(0))
    facts = cover.select(
        "doc_id", "lines",
        strip(F.coalesce("company", "own_company", F.lit(""))).alias("company"), strip(F.coalesce("sector", "own_sector", F.lit(""))).alias("sector"),
        text(first(F.filter("lines", lambda x: x["text"].rlike(K.REPORT_TYPE_LINE)))).alias("report_type"),
    )
    names = F.array(*(F.upper(c) for c in ("company", "sector", "report_type")))

    def is_identity(line: Column) -> Column:
        upper = F.upper(line["text"])
        return (F.length(line["text"]) <= 24) & (line["text"] == upper) & ~F.array_contains(names, upper)

    named = facts.withColumn("identity", text(first(F.filter("lines", is_identity))))
    taken = F.array("report_type", "identity", "sector")
    rest = named.withColumn("rest", F.filter("lines", lambda x: ~F.array_contains(taken, x["text"])))
    longest = F.array_max(F.transform("rest", lambda x: F.struct(F.length(x["text"]).alias("n"), (-x["block_idx"]).alias("at"), x["text"].alias("text"))))
    titled = rest.withColumn("title", longest)
    after = titled.withColumn("next", first(F.filter("rest", lambda x: x["block_idx"] > -F.col("title.at")))["text"])
    subtitle = F.when((F.col("next") != F.col("title.text")) & (F.length("next") <= 120), F.col("next"))
    ticker = F.when((F.col("company") != "") & (F.col("identity") != F.col("company")), F.col("identity"))
    return after.select(
        "doc_id", "report_type", "identity", F.coalesce("title.text", F.lit("")).alias("title"), F.coalesce(subtitle, F.lit("")).alias("subtitle"),
        "company", "sector", F.coalesce(ticker, F.lit("")).alias("ticker"),
    )


# --- tables, colours, images, notes ----------------------------------------------------------

def callout_from_table(blocks: DataFrame) -> DataFrame:
    """One-cell tables that are callouts: ``(doc_id, block_idx, title, text)``."""
    single = blocks.filter("kind = 't' and n_rows = 1 and n_cols = 1").select(
        *KEY, strip(F.col("text")).alias("text"), "fill"
    ).filter("text <> ''")
    titled = single.withColumn("title", O.callout_title(F.col("text"), F.col("fill"))).filter("title is not null")
    return titled.select(*KEY, "title", O.callout_body(F.col("text"), F.col("title")).alias("text"))


def column_alignment_vote(cells: DataFrame) -> DataFrame:
    """Right if any cell is, else center if any is, else left."""
    return cells.groupBy(*KEY, "col_idx").agg(
        F.when(F.bool_or(F.col("align") == "right"), "right")
        .when(F.bool_or(F.col("align") == "center"), "center")
        .otherwise("left").alias("alignment")
    )


def theme_color(runs: DataFrame, theme: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Runs with ``color_hex`` from the theme, tint and shade applied."""
    keys = scope or []
    colors = theme.select(*keys, O.theme_key(F.col("name")).alias("_theme"), F.col("hex").alias("_hex"))
    joined = runs.withColumn("_theme", O.theme_key(F.col("theme_color"))).join(colors, [*keys, "_theme"], "left")
    return joined.withColumn("color_hex", O.shaded_color(F.col("_hex"), F.col("tint"), F.col("shade"))).drop("_theme", "_hex")


def image_refs(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """First reference of every image in a paragraph, with its asset and alt text."""
    alt = O.alt_text(F.col("descr"), F.col("title"), F.col("name"))
    firsts = refs.groupBy(*KEY, "rel_id").agg(
        F.min("ord").alias("ord"), F.min_by(alt, "ord").alias("alt")
    )
    joined = firsts.join(assets, ["doc_id", "rel_id"], "left")
    return joined.select(
        *KEY, "ord", "rel_id",
        F.coalesce(F.nullif(F.col("alt"), F.lit("")), F.col("default_alt_text"), F.lit("Image")).alias("alt_text"),
        F.coalesce("path", F.lit("")).alias("path"), "mime",
    )


def split_mixed_paragraphs(tokens: DataFrame) -> DataFrame:
    """Alternating text and image parts of paragraphs: ``(…, part, kind, text)``.

    Windows span one paragraph.
    """
    w = Window.partitionBy(*KEY).orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, 0)
    image = F.col("kind") == "image"
    tokens = tokens.withColumn("kind", F.when(image, "image").otherwise("text"))
    islands = tokens.withColumn("n", F.sum(image.cast("int")).over(w)).withColumn(
        "island", 2 * F.col("n") - image.cast("int")
    )
    parts = islands.groupBy(*KEY, "island", "kind").agg(
        F.array_sort(F.collect_list(F.struct("tok_idx", "text"))).alias("t")
    )
    joined = F.array_join(F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))), "")
    text = F.when(F.col("kind") == "image", F.lit("")).otherwise(lstrip(rstrip(joined)))
    kept = parts.select(*KEY, "island", "kind", text.alias("text")).filter("kind = 'image' or text <> ''")
    order = Window.partitionBy(*KEY).orderBy("island")
    return kept.select(*KEY, (F.row_number().over(order) - 1).alias("part"), "kind", "text")


def semantic_bookmarks(blocks: DataFrame) -> DataFrame:
    """Block types carried by bookmark names."""
    out = blocks.select(*KEY, O.bookmark_parts(F.col("bookmark")).alias("b")).filter("b is not null")
    return out.select(*KEY, "b.type", "b.extra")


def native_notes(notes: DataFrame) -> DataFrame:
    """Footnotes with a positive number and no special type, pieces joined by blanks."""
    piece = strip(F.col("piece"))
    real = notes.filter(
        (F.coalesce("type", F.lit("")) == "") & F.col("id").rlike(r"^\d+$") & (F.col("id").try_cast("int") > 0)
    ).filter(piece != "")
    # pieces of one note only
    joined = real.groupBy("doc_id", "id").agg(
        F.array_sort(F.collect_list(F.struct("ord", piece.alias("piece")))).alias("p")
    )
    return joined.select(
        "doc_id", F.col("id").cast("int").alias("num"), F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text")
    )
