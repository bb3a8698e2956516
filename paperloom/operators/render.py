"""Blocks and whole documents back to Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import exprs as E
from ..functions import render as R
from ..options import ParseOptions, RenderOptions

DEFAULT = RenderOptions()


def render_blocks(spans: DataFrame, options: RenderOptions = DEFAULT) -> DataFrame:
    """Markdown of every block: ``(doc_id, block_idx, code, markdown)``."""
    return spans.select(
        "doc_id", "block_idx", "code", E.block_markdown(options).alias("markdown")
    )


def assemble_documents(
    corpus: DataFrame, options: RenderOptions = DEFAULT, parse: ParseOptions = ParseOptions()
) -> DataFrame:
    """One normalised Markdown text per document, in one narrow pass (no shuffle)."""
    return parsed_documents(corpus, parse).select("doc_id", E.markdown(options, parse).alias("markdown"))


def parsed_documents(corpus: DataFrame, parse: ParseOptions = ParseOptions()) -> DataFrame:
    """``(doc_id, text, d)``: texts and what ``metadata.document`` says of them, both evaluated once.

    A generated row is handed on as it is; the result of a nested lambda is copied at every level.
    """
    texts = corpus.select("doc_id", F.explode_outer(F.array("text")).alias("text"))
    return texts.select("doc_id", "text", F.explode_outer(F.array(E.document(parse.strict_reference_header))).alias("d"))


def assemble_from_blocks(
    rendered: DataFrame, front: DataFrame | None = None, notes: DataFrame | None = None
) -> DataFrame:
    """Same from stored tables ``rendered(doc_id, block_idx, markdown)``.

    Parts of a document meet in one aggregation on ``doc_id``; the map side
    already joins the parts that sit in one partition.
    """
    def part(df: DataFrame, kind: int, idx: Column, text: str) -> DataFrame:
        return df.select("doc_id", F.lit(kind).alias("kind"), idx.alias("idx"), F.col(text).alias("part"))

    rows = part(
        rendered.withColumn("markdown", F.concat("markdown", F.lit("\n"))), 1, F.col("block_idx").cast("long"), "markdown"
    )
    if front is not None:
        rows = rows.unionByName(part(front, 0, F.lit(0).cast("long"), "frontmatter"))
    if notes is not None:
        rows = rows.unionByName(part(notes, 2, F.lit(0).cast("long"), "endnotes"))
    joined = (
        rows.filter(~F.col("part").isin("", "\n"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("kind", "idx", "part"))).alias("p"))
    )
    text = F.array_join(F.transform("p", lambda x: x["part"]), "\n")
    return joined.select("doc_id", R.normalize_markdown(text).alias("markdown"))


def normalize_documents(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", R.normalize_markdown(F.col("text")).alias("text"))


def roundtrip_corpus(corpus: DataFrame, options: RenderOptions = DEFAULT) -> DataFrame:
    """Second version of a corpus: parse, render, ready to be parsed again."""
    return assemble_documents(corpus, options).withColumnRenamed("markdown", "text")


# --- outcome per element ------------------------------------------------------------------

def _bad_image(code: Column, lines: Column) -> Column:
    return (code == "I") & F.try_to_binary(B.image_parts(code, lines)["data"], F.lit("base64")).isNull()


def _bad_equation(code: Column, lines: Column) -> Column:
    text = F.array_join(lines, "\n")
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.contains(F.lit("LM"), code) & (count("{") != count("}"))


#: Why a block can't be rendered: a reason, and what is true of such a block's code and lines. Callers add their own.
CHECKS: dict[str, Callable[[Column, Column], Column]] = {"image data": _bad_image, "equation braces": _bad_equation}


def error_marker(kind: Column) -> Column:
    """What stands in the text in place of a block that failed."""
    return F.concat(F.lit("[Render Error: "), kind, F.lit("]"))


def render_outcome(
    spans: DataFrame, options: RenderOptions = DEFAULT, checks: dict[str, Callable[[Column, Column], Column]] | None = None
) -> DataFrame:
    """``(doc_id, block_idx, type, markdown, error)``: every block rendered, or a marker and the reason why it isn't.

    A block that fails costs the document only itself. The reason is that of the first check that holds; a check that
    can't tell (null) doesn't hold.
    """
    code, lines = F.col("code"), F.col("lines")
    reasons = [F.when(fails(code, lines), F.lit(name)) for name, fails in (CHECKS if checks is None else checks).items()]
    found = spans.withColumn("error", F.coalesce(*reasons, F.lit(None).cast("string")))
    markdown = F.when(F.col("error").isNull(), E.block_markdown(options)).otherwise(error_marker(F.col("type")))
    return found.select("doc_id", "block_idx", "type", markdown.alias("markdown"), "error")


def outcome_counts(rendered: DataFrame) -> DataFrame:
    """``(doc_id, rendered, failed, status)``; documents with a failed block go to quarantine or repair by ``status``."""
    counts = rendered.groupBy("doc_id").agg(F.count_if(F.col("error").isNull()).alias("rendered"), F.count("error").alias("failed"))
    return counts.withColumn("status", F.when(F.col("failed") > 0, "incomplete").otherwise("complete"))
