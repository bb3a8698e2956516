"""Pipe tables: rows, alignments, types and per-cell flags, all inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import contains_any, group, has_digit, let, strip, strip_bound

RULE_ROW = r"^[|\-: ]*$"


def split_row(line: Column, keep_empty: bool = False) -> Column:
    """Trimmed cells; empty cells vanish unless ``keep_empty``."""
    # blanks first, by the cheap trim; what is left is seldom more than plain text
    cells = F.transform(F.transform(F.split(line, r"\|", -1), lambda c: F.trim(c)), strip_bound)
    if keep_empty:
        return F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 2, F.lit(0)))
    return F.filter(cells, lambda c: c != "")


def table_grid(lines: Column, keep_empty: bool = False) -> Column:
    """``array<array<string>>`` of all rows but rule rows, not yet padded."""
    stripped = F.transform(lines, strip_bound)
    return F.transform(
        F.filter(stripped, lambda x: ~x.rlike(RULE_ROW)), lambda x: split_row(x, keep_empty)
    )


def rule_alignments(lines: Column, n_cols: Column) -> Column:
    rules = F.filter(
        F.transform(lines, strip_bound), lambda x: F.contains(x, F.lit("-")) & x.rlike(RULE_ROW)
    )
    found = F.transform(
        split_row(F.coalesce(F.get(rules, F.lit(0)), F.lit(""))),
        lambda c: F.when(c.startswith(":") & c.endswith(":"), F.lit("center"))
        .when(c.endswith(":"), F.lit("right"))
        .otherwise(F.lit("left")),
    )
    return let(
        found,
        lambda a: F.when(F.size(a) == n_cols, a).otherwise(F.array_repeat(F.lit("left"), n_cols)),
    )


def table_type(header: Column) -> Column:
    """First keyword group found in the lower-cased joined header."""
    text = F.lower(F.array_join(header, " "))
    chain = F
    for name, words in K.TABLE_KEYWORDS.items():
        chain = chain.when(contains_any(text, words), F.lit(name))
    return chain.otherwise(F.lit("GENERIC"))


def padded(cells: Column, n_cols: Column) -> Column:
    fill = F.array_repeat(F.lit(""), F.greatest(n_cols - F.size(cells), F.lit(0)))
    return F.when(F.size(cells) == n_cols, cells).otherwise(F.slice(F.concat(cells, fill), F.lit(1), n_cols))


def _header(grid: Column) -> Column:
    return F.coalesce(F.get(grid, F.lit(0)), F.array().cast("array<string>"))


def table_texts(lines: Column, keep_empty: bool = False) -> Column:
    """``struct<rows, alignments>`` of ``table_parts``: what a table shows, nothing else of it is computed."""

    def texts(grid: Column) -> Column:
        return let(
            F.size(_header(grid)),
            lambda n: F.struct(F.transform(grid, lambda r: padded(r, n)).alias("rows"), rule_alignments(lines, n).alias("alignments")),
        )

    return let(table_grid(lines, keep_empty), texts)


def table_cell_texts(lines: Column, keep_empty: bool = False) -> Column:
    """``rows`` of ``table_parts`` alone."""
    of_grid = lambda grid: let(F.size(_header(grid)), lambda n: F.transform(grid, lambda r: padded(r, n)))
    return let(table_grid(lines, keep_empty), of_grid)


def table_parts(lines: Column, keep_empty: bool = False) -> Column:
    """``struct<table_type, n_cols, n_rows, alignments, header, rows, dropped>``."""

    def parts(grid: Column) -> Column:
        return let(
            _header(grid),
            lambda h: F.struct(
                table_type(h).alias("table_type"),
                F.size(h).alias("n_cols"),
                F.size(grid).alias("n_rows"),
                rule_alignments(lines, F.size(h)).alias("alignments"),
                h.alias("header"),
                F.transform(grid, lambda r: padded(r, F.size(h))).alias("rows"),
                F.transform(
                    grid,
                    lambda r: F.when(F.size(r) > F.size(h), F.slice(r, F.size(h) + 1, F.size(r) - F.size(h))).otherwise(
                        F.array().cast("array<string>")
                    ),
                ).alias("dropped"),
            ),
        )

    return let(table_grid(lines, keep_empty), parts)


def cell_is_numeric(text: Column, col_idx: Column) -> Column:
    return has_digit(text) & (col_idx > 0)


def cell_is_negative(text: Column) -> Column:
    return ((text.startswith("(") & text.endswith(")")) | text.startswith("-")) & has_digit(text)


def cell_is_base_case(
    text: Column, row_idx: Column, col_idx: Column, n_rows: Column, n_cols: Column
) -> Column:
    half = lambda n: F.floor(n / 2)
    return (
        F.contains(F.lower(text), F.lit("base"))
        | F.contains(text, F.lit("기준"))
        | ((row_idx == half(n_rows)) & (col_idx == half(n_cols)) & (row_idx > 0))
    )


def cell_risk_level(text: Column, header: Column) -> Column:
    low = F.lower(text)
    chain = F
    for level, (lower_words, words) in K.RISK_LEVELS.items():
        chain = chain.when(contains_any(low, lower_words) | contains_any(text, words), F.lit(level))
    return F.when(contains_any(F.lower(header), K.RISK_HEADER_WORDS), chain.otherwise(None))


def is_numeric_like(text: Column) -> Column:
    t = strip(text)
    return has_digit(t) & t.rlike(K.NUMERIC_LIKE)


def thousands(digits: Column) -> Column:
    """Thousand separators for an unsigned number, decimals kept."""
    whole = F.regexp_replace(group(digits, r"^(\d+)", 1), F.lit(r"^0+(?=\d)"), F.lit(""))
    return F.concat(
        F.regexp_replace(whole, F.lit(r"(?<=\d)(?=(\d{3})+$)"), F.lit(",")), group(digits, r"^\d+(.*)$", 1)
    )


def format_financial(text: Column) -> Column:
    """``1234567`` -> ``1,234,567``; also ``(n)``, ``-n`` and ``n<suffix>``."""
    number = r"(\d+(?:\.\d+)?)"
    paren, minus, plain = rf"(?d)^\({number}\)(.*)$", rf"(?d)^-{number}(.*)$", rf"(?d)^{number}(.*)$"
    return let(
        strip(text),
        lambda t: F.when(~has_digit(t) | t.rlike(r"\d{1,3}(,\d{3})+"), t)
        .when(
            t.rlike(paren),
            F.concat(F.lit("("), thousands(group(t, paren, 1)), F.lit(")"), group(t, paren, 2)),
        )
        .when(t.rlike(minus), F.concat(F.lit("-"), thousands(group(t, minus, 1)), group(t, minus, 2)))
        .when(t.rlike(plain), F.concat(thousands(group(t, plain, 1)), group(t, plain, 2)))
        .otherwise(t),
    )


def display_text(text: Column, col_idx: Column, kind: Column) -> Column:
    return F.when(
        (kind == "FINANCIAL") & cell_is_numeric(text, col_idx), format_financial(text)
    ).otherwise(text)


def column_profiles(lines: Column, keep_empty: bool = False) -> Column:
    """Per column of a table: kind, representative length, longest token, width score.

    Takes from the lines only what a profile needs: no alignments, no cut cells.
    """

    def of_grid(grid: Column) -> Column:
        header = F.coalesce(F.get(grid, F.lit(0)), F.array().cast("array<string>"))
        return let(
            F.struct(grid.alias("rows"), F.size(header).alias("n_cols"), (table_type(header) == "FINANCIAL").alias("financial")),
            of_table,
        )

    def of_table(t: Column) -> Column:
        # cells are trimmed, only those that are formatted can need it again
        def shown(text: Column, col: Column) -> Column:
            return F.when(t["financial"] & cell_is_numeric(text, col), strip(format_financial(text))).otherwise(text)

        def cells(col: Column) -> Column:
            rows = F.transform(t["rows"], lambda r, i: F.struct(i.alias("row_idx"), F.coalesce(F.get(r, col), F.lit("")).alias("text")))
            filled = F.filter(rows, lambda c: c["text"] != "")
            both = F.transform(filled, lambda c: F.struct(c["row_idx"].alias("row_idx"), shown(c["text"], col).alias("text")))
            return F.when(t["financial"], F.filter(both, lambda c: c["text"] != "")).otherwise(filled)

        profile = lambda col: let(cells(col), lambda c: _profile(col, c))
        return F.when(t["n_cols"] > 0, F.transform(F.sequence(F.lit(0), t["n_cols"] - 1), profile)).otherwise(F.array().cast(PROFILE))

    return let(table_grid(lines, keep_empty), of_grid)


PROFILE = (
    "array<struct<col_idx:int,kind:string,representative_length:int,longest_token:int,score:double>>"
)


def _profile(col: Column, cells: Column) -> Column:
    sample = F.slice(F.filter(cells, lambda c: c["row_idx"] > 0), F.lit(1), F.lit(3))
    numeric = F.size(F.filter(sample, lambda c: is_numeric_like(c["text"])))
    # integer form of numeric >= (n + 1) // 2
    kind = F.when(
        (F.size(sample) > 0) & (numeric >= F.floor((F.size(sample) + 1) / 2)), F.lit("numeric")
    ).otherwise(F.lit("text"))
    lengths = F.sort_array(F.transform(cells, lambda c: F.length(c["text"])))
    rep = F.coalesce(
        F.get(lengths, F.bround((F.size(lengths) - 1) * F.lit(0.75), 0).cast("int")), F.lit(0)
    )
    # cells joined by a break: one split finds the tokens of the whole column
    tokens = F.split(F.array_join(F.transform(cells, lambda c: c["text"]), "\n"), r"(?U)[\s\x1c-\x1f]+", -1)
    token = F.array_max(F.transform(tokens, F.length))
    score = F.when(
        kind == "numeric", F.lit(1.0) + F.least(rep, F.lit(12)) * F.lit(0.05)
    ).otherwise(
        F.lit(1.8) + F.least(rep, F.lit(48)) * F.lit(0.06) + F.least(token, F.lit(24)) * F.lit(0.03)
    )
    return F.struct(
        col.cast("int").alias("col_idx"), kind.alias("kind"),
        rep.cast("int").alias("representative_length"), token.cast("int").alias("longest_token"),
        score.cast("double").alias("score"),
    )
