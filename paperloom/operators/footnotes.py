"""Footnote definitions, references and their join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import footnotes as N
from ..functions.text import is_digits, let, strip
from ..options import ParseOptions
from .inline import block_runs
from .structure import explode_rows

DEFAULT = ParseOptions()


def footnote_defs(corpus: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """``footnotes(doc_id, num, text)``; the last of equal numbers wins."""
    out = explode_rows(corpus, ["doc_id"], E.final_notes(options.caret_definitions), "p", "n")
    return out.select("doc_id", "n.num", "n.text")


def footnote_marks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``.N`` and ``^N^`` marks of a text: ``(*keys, pos, num)``."""
    return explode_rows(rows, keys, N.inline_references(F.col("text")), "pos", "num")


def footnote_refs(runs: DataFrame) -> DataFrame:
    """Superscript digit runs: ``(doc_id, block_idx, run_idx, num)``."""
    text = strip(F.col("text"))
    refs = runs.filter(F.col("superscript") & is_digits(text))
    return refs.select("doc_id", "block_idx", "row_idx", "col_idx", "run_idx", text.try_cast("int").alias("num"))


def superscript_refs(spans: DataFrame) -> DataFrame:
    """``footnote_refs`` of the runs of blocks: runs are built only of blocks, and in tables of cells, with a ``^``.

    A superscript is a piece of its source lines between two such marks, so no other text holds a reference.
    """
    return footnote_refs(block_runs(spans.filter(F.exists("lines", lambda x: F.contains(x, F.lit("^")))), "^"))


def resolve_footnotes(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """References that meet a definition, with the note text."""
    return refs.join(notes.select("doc_id", "num", F.col("text").alias("note")), ["doc_id", "num"], "inner")


def kept_notes(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes to print: the referenced ones, or all of a document without references.

    Notes (one per document and number) and references meet in one aggregation, references counted on the map side first, so
    that a document with very many of them is not skewed; whether any note of a document is used is a window over its notes.
    """
    rows = notes.select("doc_id", "num", F.struct("text").alias("note"), F.lit(False).alias("used")).unionByName(
        refs.select("doc_id", "num", F.lit(True).alias("used")), allowMissingColumns=True
    )
    met = rows.groupBy("doc_id", "num").agg(F.max("note").alias("note"), F.max("used").alias("used")).filter("note IS NOT NULL")
    marked = met.withColumn("is_native", F.max("used").over(Window.partitionBy("doc_id")))
    return marked.filter(F.col("used") | ~F.col("is_native")).select("doc_id", "num", "note.text", "is_native")


def dangling_refs(refs: DataFrame, notes: DataFrame) -> DataFrame:
    return refs.join(notes.select("doc_id", "num"), ["doc_id", "num"], "left_anti")


def unused_notes(refs: DataFrame, notes: DataFrame) -> DataFrame:
    return notes.join(refs.select("doc_id", "num").distinct(), ["doc_id", "num"], "left_anti")


def endnotes_text(corpus: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """``## Citations`` section of every document that has notes."""
    out = corpus.select(
        "doc_id", let(E.final_notes(options.caret_definitions), N.endnotes_text).alias("endnotes")
    )
    return out.filter(F.col("endnotes") != "")
