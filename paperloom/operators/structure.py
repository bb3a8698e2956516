"""Lines, blocks, headings, sections.

Input of every operator: a corpus ``(doc_id, text)``.  Documents are parsed by
one narrow expression per row; only operators that rank or look back over
exploded rows shuffle, and then by ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import constants as K
from ..functions import exprs as E
from ..functions import lexer as L
from ..functions import metadata as M
from ..functions.running import CHUNK, running
from ..functions.text import group, let, normalize_spacing, strip, strip_anchors
from ..options import ParseOptions, SeparatorOptions

DEFAULT = ParseOptions()


def explode_rows(df: DataFrame, keys: list[str], items: Column, pos: str, item: str) -> DataFrame:
    """One row per array element.

    The outer form is used on purpose: the inner form makes the optimizer add a
    ``size(...) > 0`` filter that evaluates the whole parse a second time.
    """
    out = df.select(*keys, F.posexplode_outer(items).alias(pos, item))
    return out.filter(F.col(pos).isNotNull())


def split_lines(corpus: DataFrame) -> DataFrame:
    """``lines(doc_id, line_no, text)``; only ``\\n`` ends a line."""
    return explode_rows(corpus, ["doc_id"], L.split_lines(F.col("text")), "line_no", "text")


def frontmatter_span(corpus: DataFrame) -> DataFrame:
    """Documents that start with a ``---`` block: number of lines, and whether it is metadata."""

    def span(lines: Column) -> Column:
        return let(
            L.frontmatter_close(lines),
            lambda p: F.when(
                p > 0,
                F.struct((p + 1).alias("n_lines"), (L.frontmatter_length(lines) > 0).alias("is_valid")),
            ),
        )

    spans = corpus.select("doc_id", let(L.split_lines(F.col("text")), span).alias("s"))
    return spans.select("doc_id", "s.n_lines", "s.is_valid").filter(F.col("n_lines").isNotNull())


def frontmatter_valid(corpus: DataFrame) -> DataFrame:
    """``(doc_id, is_valid)`` for every document; false without a metadata block."""
    return corpus.select(
        "doc_id", (let(L.split_lines(F.col("text")), L.frontmatter_length) > 0).alias("is_valid")
    )


def frontmatter_pairs(corpus: DataFrame) -> DataFrame:
    """``(doc_id, key, value)``; the last of equal keys wins."""
    pairs = let(L.split_lines(F.col("text")), lambda x: M.last_wins(M.frontmatter_pairs(x)))
    return explode_rows(corpus, ["doc_id"], pairs, "pos", "pair").select("doc_id", "pos", "pair.key", "pair.value")


def classify_lines(corpus: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """``(doc_id, line_no, text, cls)`` of the lines after the metadata block."""
    def rows(lines: Column) -> Column:
        return let(
            L.frontmatter_length(lines),
            lambda fm: let(
                F.slice(lines, fm + 1, F.greatest(F.size(lines) - fm, F.lit(0))),
                lambda body: F.transform(
                    F.zip_with(
                        body,
                        L.line_classes(F.col("text"), body, fm, options.strict_reference_header),
                        lambda t, c: F.struct(t.alias("text"), c.alias("cls")),
                    ),
                    lambda r, i: F.struct((i + fm).alias("line_no"), r["text"].alias("text"), r["cls"].alias("cls")),
                ),
            ),
        )

    out = explode_rows(corpus, ["doc_id"], let(L.split_lines(F.col("text")), rows), "p", "r")
    return out.select("doc_id", "r.line_no", "r.text", "r.cls")


def segment_blocks(corpus: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """Block boundaries: ``(doc_id, block_idx, code, type, start_line, n_lines, lines)``."""
    return span_rows(corpus, E.spans(options.strict_reference_header))


def span_rows(rows: DataFrame, spans: Column) -> DataFrame:
    """One row per block of an array of blocks."""
    out = explode_rows(rows, ["doc_id"], spans, "block_idx", "b")
    return out.select(
        "doc_id", "block_idx", "b.code", B.block_type(F.col("b.code")).alias("type"),
        "b.start_line", "b.n_lines", "b.lines",
    )


def body_blocks(corpus: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """Same columns, without the header blocks that became metadata."""
    spans = E.body_spans(options.strict_reference_header)
    out = explode_rows(corpus, ["doc_id"], spans, "p", "b")
    return out.select(
        "doc_id", "b.block_idx", "b.code", B.block_type(F.col("b.code")).alias("type"),
        "b.start_line", "b.n_lines", "b.lines",
    )


def typed_blocks(spans: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """Typed columns of blocks; unused columns are pruned by the optimizer."""
    return _typed(spans, B.block_text(F.col("code"), F.col("lines"), options.keep_double_space))


def whole_blocks(spans: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """``typed_blocks`` where all columns are asked for: the text, which several need, is a generated row, evaluated once."""
    text = B.block_text(F.col("code"), F.col("lines"), options.keep_double_space)
    return _typed(spans.select("*", F.explode_outer(F.array(text)).alias("text")), F.col("text"))


def _typed(spans: DataFrame, text: Column) -> DataFrame:
    code, lines = F.col("code"), F.col("lines")
    is_item, is_image = F.contains(F.lit("BxNy"), code), F.contains(F.lit("GI"), code)
    is_code = F.contains(F.lit("FD"), code)
    return spans.select(
        "doc_id", "block_idx", "type",
        B.heading_level(code).alias("level"),
        text.alias("text"),
        F.when(code == "Q", B.quote_parts(lines)["title"]).alias("title"),
        F.when(F.contains(F.lit("Ny"), code), group(B.first_line(lines), K.NUMBERED, 2)).alias("number"),
        F.when(is_item, B.item_indent(code, lines)).alias("indent_level"),
        F.when(is_code, B.code_language(lines)).alias("language"),
        F.when(is_image, B.image_parts(code, lines)["alt_text"]).alias("alt_text"),
        F.when(is_image, B.image_parts(code, lines)["path"]).alias("path"),
        F.contains(F.lit("Wh"), code).alias("is_numbered"),
        ((code == "F") & B.is_ascii_art(B.code_text(lines))).alias("is_ascii_art"),
        ((code == "P") & B.has_inline_math(text)).alias("has_inline_latex"),
        B.raw_text(code, lines, text).alias("raw"),
        "start_line", "n_lines",
    )


def blocks(corpus: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    return typed_blocks(segment_blocks(corpus, options), options)


def _only(corpus: DataFrame, codes: str) -> DataFrame:
    return segment_blocks(corpus).filter(F.contains(F.lit(codes), F.col("code")))


def headings(corpus: DataFrame) -> DataFrame:
    code, lines = F.col("code"), F.col("lines")
    return _only(corpus, "1234W").select(
        "doc_id", "block_idx", "type", B.heading_level(code).alias("level"), B.heading_text(code, lines).alias("text")
    )


def numbered_headings(corpus: DataFrame) -> DataFrame:
    """``N. Title`` lines that are headings, with their number."""
    return _only(corpus, "h").select(
        "doc_id", "block_idx", group(F.col("lines")[0], K.NUMBERED, 2).cast("int").alias("num"),
        B.heading_text(F.col("code"), F.col("lines")).alias("text"),
    )


def separators(corpus: DataFrame, options: SeparatorOptions = SeparatorOptions()) -> DataFrame:
    raw = strip(F.col("lines")[0])
    mode = (
        F.lit(options.mode) if options.mode != "auto"
        else F.when(raw == "## ---", F.lit("page-break")).otherwise(F.lit("rule"))
    )
    return _only(corpus, "-=").select("doc_id", "block_idx", mode.alias("mode"))


def code_blocks(corpus: DataFrame) -> DataFrame:
    lines = F.col("lines")
    return _only(corpus, "F").select(
        "doc_id", "block_idx", B.code_language(lines).alias("language"), B.code_text(lines).alias("text")
    )


def ascii_art_flag(corpus: DataFrame) -> DataFrame:
    return code_blocks(corpus).select("doc_id", "block_idx", B.is_ascii_art(F.col("text")).alias("is_ascii_art"))


def diagram_blocks(corpus: DataFrame) -> DataFrame:
    lines = F.col("lines")
    return _only(corpus, "D").select(
        "doc_id", "block_idx",
        F.regexp_replace(B.code_language(lines), F.lit("^diagram:"), F.lit("")).alias("diagram_type"),
        B.code_text(lines).alias("text"),
    )


def math_blocks(corpus: DataFrame) -> DataFrame:
    return _only(corpus, "LM").select(
        "doc_id", "block_idx", B.math_text(F.col("code"), F.col("lines")).alias("text")
    )


def images(corpus: DataFrame) -> DataFrame:
    img = _only(corpus, "GI").select(
        "doc_id", "block_idx", B.image_parts(F.col("code"), F.col("lines")).alias("i")
    )
    return img.select("doc_id", "block_idx", "i.alt_text", "i.path", "i.mime", "i.data")


def callouts(corpus: DataFrame) -> DataFrame:
    q = _only(corpus, "Q").select("doc_id", "block_idx", B.quote_parts(F.col("lines")).alias("q"))
    return q.select("doc_id", "block_idx", "q.title", "q.text")


def bullet_items(corpus: DataFrame) -> DataFrame:
    code, lines = F.col("code"), F.col("lines")
    return _only(corpus, "Bx").select(
        "doc_id", "block_idx", B.item_indent(code, lines).alias("indent_level"), B.item_text(code, lines).alias("text")
    )


def numbered_items(corpus: DataFrame) -> DataFrame:
    code, lines = F.col("code"), F.col("lines")
    return _only(corpus, "Ny").select(
        "doc_id", "block_idx", group(F.col("lines")[0], K.NUMBERED, 2).alias("number"),
        B.item_indent(code, lines).alias("indent_level"), B.item_text(code, lines).alias("text"),
    )


def merge_paragraphs(corpus: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    text = B.paragraph_text(F.col("lines"), options.keep_double_space)
    return _only(corpus, "P").select(
        "doc_id", "block_idx", text.alias("text"), B.has_inline_math(text).alias("has_inline_latex")
    )


def normalize_inline_spacing(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", normalize_spacing(F.col("text")).alias("text"))


def strip_html_anchors(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", strip_anchors(F.col("text")).alias("text"))


def reference_gate(corpus: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """Lines hidden by a reference region: ``(doc_id, line_no, text)``."""
    def rows(lines: Column) -> Column:
        return let(
            L.frontmatter_length(lines),
            lambda fm: let(
                F.slice(lines, fm + 1, F.greatest(F.size(lines) - fm, F.lit(0))),
                lambda body: let(
                    F.array_join(L.line_classes(F.col("text"), body, fm, options.strict_reference_header), ""),
                    lambda cls: _hidden(cls, body, fm),
                ),
            ),
        )

    out = explode_rows(corpus, ["doc_id"], let(L.split_lines(F.col("text")), rows), "p", "r")
    return out.select("doc_id", "r.line_no", "r.text")


def _hidden(cls: Column, body: Column, offset: Column) -> Column:
    # blank out the region tokens, then keep the lines under the blanks
    tokens = F.regexp_extract_all(cls, F.lit(L.BLOCKS), F.lit(0))
    mask = F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(F.left(t, F.lit(1)).isin("R", "S", "U", "V"), F.repeat(F.lit("!"), F.length(t))).otherwise(t),
        ),
        "",
    )
    rows = F.zip_with(
        F.transform(body, lambda x, i: F.struct((i + offset).alias("line_no"), x.alias("text"))),
        F.filter(F.split(mask, ""), lambda c: c != ""),
        lambda r, c: F.struct(r["line_no"].alias("line_no"), r["text"].alias("text"), c.alias("c")),
    )
    return F.filter(rows, lambda r: r["c"] == "!")


def assign_sections(block_rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Nearest heading and heading path of every block (``doc_id, block_idx, level, text``).

    The last heading of a level is the running maximum of its place; running values are carried over chunks, so that a
    document with most of all blocks is many tasks.
    """
    place = lambda here: F.when(here, F.struct("block_idx", "text"))
    seen = {f"h{n}": place(F.col("level") == n) for n in (1, 2, 3, 4)} | {"last": place(F.col("level").isNotNull())}
    # only texts of headings are asked for
    heads = block_rows.select("doc_id", "block_idx", "level", F.when(F.col("level").isNotNull(), F.col("text")).alias("text"))
    rows = running(heads, ["doc_id"], "block_idx", maxima=seen, chunk=chunk)
    rows = rows.select("doc_id", "block_idx", F.col("last.text").alias("heading"), "h1", "h2", "h3", "h4")
    path = []
    for n in (1, 2, 3, 4):
        here = F.col(f"h{n}.block_idx")
        above = [F.coalesce(F.col(f"h{m}.block_idx"), F.lit(-1)) for m in range(1, n)]
        ok = here.isNotNull()
        for a in above:
            ok = ok & (here > a)
        path.append(F.when(ok, F.col(f"h{n}.text")))
    return rows.select(
        "doc_id", "block_idx", "heading", F.array_join(F.filter(F.array(*path), lambda x: x.isNotNull()), " > ").alias("path")
    )


def outline(corpus: DataFrame) -> DataFrame:
    """Headings in order with levels clamped to 1-4; ``entry_no`` counts per document."""
    heads = E.spans()
    entries = F.filter(
        F.transform(
            F.filter(heads, lambda b: B.is_heading(b["code"])),
            lambda b: F.struct(
                F.greatest(F.lit(1), F.least(B.heading_level(b["code"]), F.lit(4))).alias("level"),
                strip(B.heading_text(b["code"], b["lines"])).alias("text"),
            ),
        ),
        lambda e: e["text"] != "",
    )
    out = explode_rows(corpus, ["doc_id"], entries, "entry_no", "e")
    return out.select("doc_id", "entry_no", "e.level", "e.text")
