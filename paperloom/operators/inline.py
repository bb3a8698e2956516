"""Styled runs and text forms of ``(doc_id, ..., text)`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import exprs as E
from ..functions import runs as R
from ..functions.text import let, unescape, unescape_strip
from .structure import explode_rows

RUN_FIELDS = ["text", "bold", "italic", "superscript", "subscript", "is_latex", "color_hex"]


def runs_of(rows: DataFrame, keys: list[str], math: bool = True) -> DataFrame:
    """One row per run of column ``text``: ``(*keys, run_idx, text, bold, ...)``."""
    out = explode_rows(rows, keys, R.inline_runs(F.col("text"), math), "run_idx", "r")
    return out.select(*keys, "run_idx", *[f"r.{f}" for f in RUN_FIELDS])


def plain_runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Runs where ``$`` is plain text (currency-safe)."""
    return runs_of(rows, keys, math=False)


def color_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Coloured parts of a text: ``(*keys, pos, text, color_hex)``."""
    out = explode_rows(rows, keys, R.color_pieces(F.col("text")), "pos", "c").filter("c.color is not null")
    return out.select(*keys, "pos", "c.text", F.col("c.color").alias("color_hex"))


def inline_math(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``$...$`` expressions: ``(*keys, pos, expression)``."""
    found = F.regexp_extract_all(F.col("text"), F.lit(K.INLINE_MATH), F.lit(1))
    candidates = rows.filter(F.contains(F.col("text"), F.lit("$")))
    return explode_rows(candidates, keys, found, "pos", "expression")


def unescape_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    t = F.col("text")
    return rows.select(*keys, unescape_strip(t).alias("text"), unescape(t).alias("text_spaced"))


def block_runs(spans: DataFrame, mark: str | None = None) -> DataFrame:
    """``runs`` relation of paragraphs and list items, plus cells (``row_idx``, ``col_idx``).

    With ``mark``, only cells that hold it have runs; their places stay the same.
    """
    code, lines = F.col("code"), F.col("lines")
    no = F.lit(None).cast("int")
    flat = F.array(F.struct(no.alias("row_idx"), no.alias("col_idx"), R.flowing_text(code, lines).alias("text")))
    cells = lambda rows: F.flatten(
        F.transform(rows, lambda row, i: F.transform(row, lambda c, j: F.struct(i.alias("row_idx"), j.alias("col_idx"), c.alias("text"))))
    )
    texts = F.when(code == "T", let(E.table_cell_texts(), cells)).otherwise(flat)
    # texts are rows before their runs are looked for: most have one, and that needs no lambda
    per_text = explode_rows(spans.filter(F.contains(F.lit("PBxNyT"), code)), ["doc_id", "block_idx"], texts, "g", "x")
    keyed = per_text.select("doc_id", "block_idx", "x.row_idx", "x.col_idx", "x.text").filter("text IS NOT NULL")
    if mark is not None:
        keyed = keyed.filter(F.col("row_idx").isNull() | F.contains("text", F.lit(mark)))
    keys = ["doc_id", "block_idx", "row_idx", "col_idx"]
    runs = R.inline_runs(F.col("text"), F.col("row_idx").isNull() | R.cell_math(F.col("text")), bound=True)
    out = explode_rows(keyed, keys, runs, "run_idx", "r")
    return out.select(*keys, "run_idx", *[f"r.{f}" for f in RUN_FIELDS])


def run_counts(spans: DataFrame) -> DataFrame:
    """Bold and italic runs per block that can hold runs."""
    counted = spans.filter(F.contains(F.lit("PBxNyT"), F.col("code"))).select(
        "doc_id", "block_idx", R.run_counts_of(E.block_runs()).alias("n")
    )
    return counted.select(
        "doc_id", "block_idx", F.col("n.bold").alias("bold_runs"), F.col("n.italic").alias("italic_runs")
    )
