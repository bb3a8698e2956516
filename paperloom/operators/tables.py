"""Table operators over blocks ``(doc_id, block_idx, code, lines)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import tables as T
from ..functions.text import let
from ..options import ParseOptions
from .structure import explode_rows

KEY = ["doc_id", "block_idx"]
DEFAULT = ParseOptions()


def _parts(options: ParseOptions) -> Column:
    return E.table_parts(options.keep_empty_cells)


def _tables(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("code") == "T")


def _parsed(spans: DataFrame, options: ParseOptions) -> DataFrame:
    return _tables(spans).select(*KEY, _parts(options).alias("t"))


def table_rows(spans: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """Rows other than rule rows with their cells, not padded."""
    grid = T.table_grid(F.col("lines"), options.keep_empty_cells)
    return explode_rows(_tables(spans), KEY, grid, "row_idx", "cells")


def tables(spans: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """One row per table: type, shape and column alignments."""
    return _parsed(spans, options).select(
        *KEY, "t.table_type", "t.n_cols", "t.n_rows", F.array_join("t.alignments", ",").alias("alignments")
    )


def column_alignments(spans: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    out = explode_rows(_parsed(spans, options), KEY, F.col("t.alignments"), "col_idx", "alignment")
    return out


def classify_table(spans: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    header = F.coalesce(F.get(T.table_grid(F.col("lines"), options.keep_empty_cells), F.lit(0)), F.array().cast("array<string>"))
    return _tables(spans).select(*KEY, T.table_type(header).alias("table_type"))


def table_shape(spans: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    return _parsed(spans, options).select(*KEY, "t.n_rows", "t.n_cols")


def table_cells(spans: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """One row per cell with all flags; short rows padded, long rows cut."""

    def cells(t: Column) -> Column:
        def cell(text: Column, i: Column, j: Column) -> Column:
            return F.struct(
                i.alias("row_idx"),
                j.alias("col_idx"),
                text.alias("text"),
                F.coalesce(F.get(t["alignments"], j), F.lit("left")).alias("alignment"),
                t["table_type"].alias("table_type"),
                t["n_rows"].alias("n_rows"),
                t["n_cols"].alias("n_cols"),
                F.get(t["header"], j).alias("header"),
            )

        return F.flatten(
            F.transform(t["rows"], lambda row, i: F.transform(row, lambda c, j: cell(c, i, j)))
        )

    out = explode_rows(_tables(spans), KEY, let(_parts(options), cells), "p", "c")
    text, row_idx, col_idx = F.col("c.text"), F.col("c.row_idx"), F.col("c.col_idx")
    kind = F.col("c.table_type")
    return out.select(
        *KEY, "c.row_idx", "c.col_idx", "c.text", "c.alignment", "c.table_type",
        (row_idx == 0).alias("is_header"),
        T.cell_is_numeric(text, col_idx).alias("is_numeric"),
        T.cell_is_negative(text).alias("is_negative"),
        (
            (kind == "BEP_SENSITIVITY")
            & T.cell_is_base_case(text, row_idx, col_idx, F.col("c.n_rows"), F.col("c.n_cols"))
        ).alias("is_base_case"),
        F.when(kind == "RISK_MATRIX", T.cell_risk_level(text, F.col("c.header"))).alias("risk_level"),
    )


def dropped_cells(spans: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """Cells beyond the header width: ``(…, row_idx, col_idx, text)``."""
    rows = explode_rows(_parsed(spans, options), [*KEY, "t.n_cols"], F.col("t.dropped"), "row_idx", "cells")
    out = explode_rows(rows, [*KEY, "row_idx", "n_cols"], F.col("cells"), "k", "text")
    return out.select(*KEY, "row_idx", (F.col("n_cols") + F.col("k")).alias("col_idx"), "text")


def column_profile(spans: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    """Kind, lengths and width score of every column."""
    out = explode_rows(_tables(spans), KEY, E.column_profiles(options.keep_empty_cells), "p", "c")
    return out.select(
        *KEY, "c.col_idx", "c.kind", "c.representative_length", "c.longest_token", "c.score"
    )


def column_kinds(spans: DataFrame, options: ParseOptions = DEFAULT) -> DataFrame:
    return column_profile(spans, options).select(*KEY, "col_idx", "kind")


def financial_cells(cells: DataFrame) -> DataFrame:
    """Display text of cells: numbers of FINANCIAL tables get separators."""
    return cells.select(
        *KEY, "row_idx", "col_idx",
        T.display_text(F.col("text"), F.col("col_idx"), F.col("table_type")).alias("display_text"),
    )


def numeric_like(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, T.is_numeric_like(F.col("text")).alias("is_numeric_like"))


def format_financial(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, T.format_financial(F.col("text")).alias("formatted"))
