"""Office block tables derived from orders.

A document is a range of order keys, so it is bounded and no key is hot; order
rows are its body, a few fixed blocks around them are its cover and tail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as K
from .corpora import table

DOC_SIZE = 512
BODY = 20      # first body position
TAIL = 600     # first position after the body
GENERATOR = "report writer"

STYLES = [
    # style_id, name, base_style_id, outline_lvl
    ("Heading3", "heading 3", None, None),
    ("Heading2", "heading 2", None, 5),
    ("Mid", "Mid", "Heading3", None),
    ("Custom", "Custom", "Mid", None),
    ("ListBullet", "List Bullet", "Normal", None),
    ("ListNumber2", "List Number 2", "Normal", None),
    ("ListParagraph", "List Paragraph", "Normal", None),
    ("Outline", "Outline", "Normal", 0),
    ("Loop", "Loop", "LoopB", None),
    ("LoopB", "LoopB", "Loop", None),
    ("Normal", "Normal", None, None),
    ("TOC1", "toc 1", "Normal", None),
]
NUMBERING = [("1", "10"), ("2", "20")]
NUM_LEVELS = [("10", 0, "decimal"), ("10", 1, "lowerLetter"), ("10", 2, "lowerRoman"), ("20", 0, "bullet"), ("20", 1, "upperRoman")]


def styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STYLES, "style_id string, name string, base_style_id string, outline_lvl int")


def numbering(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NUMBERING, "num_id string, abstract_id string")


def numbering_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NUM_LEVELS, "abstract_id string, ilvl int, num_fmt string")


def body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows as paragraphs."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey DIV {DOC_SIZE} AS doc_id",
        f"o_orderkey % {DOC_SIZE} + {BODY} AS block_idx",
        "'p' AS kind",
        """CASE WHEN o_orderkey % 32 = 22 THEN '• item ' || o_orderkey WHEN o_orderkey % 32 = 30 THEN '3) item ' || o_orderkey
           WHEN o_orderkey % 32 = 6 AND o_orderkey % 5 = 0 THEN 'Full stop ' || o_orderkey || '.'
           ELSE o_orderpriority || ' ' || o_orderkey END AS text""",
        """CASE o_orderkey % 8 WHEN 0 THEN 'Heading2' WHEN 1 THEN 'Custom' WHEN 2 THEN 'ListBullet' WHEN 3 THEN 'ListNumber2'
           WHEN 4 THEN 'Outline' WHEN 5 THEN 'Loop' WHEN 7 THEN 'ListParagraph' END AS style_id""",
        """CASE WHEN o_orderkey % 8 IN (3, 7) AND o_orderkey % 3 < 2 THEN CASE WHEN o_orderkey % 5 < 3 THEN '1' ELSE '2' END END AS num_id""",
        """CASE WHEN o_orderkey % 8 IN (3, 7) AND o_orderkey % 3 < 2 THEN CAST((o_orderkey DIV 8) % 3 * CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 1 END AS INT) END AS ilvl""",
        "CASE WHEN o_orderkey % 8 = 7 THEN (o_orderkey DIV 8) % 4 * 18.0D + 9.0D END AS left_indent_pt",
        "o_orderkey % 32 = 6 AS all_bold",
        "CASE WHEN o_orderkey % 32 = 14 THEN 2 END AS outline_lvl",
        "CAST(NULL AS INT) AS n_rows", "CAST(NULL AS INT) AS n_cols", "CAST(NULL AS STRING) AS fill",
        """CASE o_orderkey % 6 WHEN 0 THEN '_ibrep_SEPARATOR' WHEN 1 THEN '_ibrep_CODE_BLOCK_sql_0a1F' WHEN 2 THEN '_ibrep_DIAGRAM_beef'
           WHEN 3 THEN '_ibrep_CODE_BLOCK_py_' WHEN 4 THEN 'other_SEPARATOR' END AS bookmark""",
        "false AS has_object",
    )


# doc_id % 4: 0 panel and cover note, 1 panel and a title line, 2 title lines only, 3 named by property
_EXTRA = [
    # position, condition, kind, text, rows, columns, style
    (0, "d % 4 < 2", "p", "'INVESTMENT MEMO'", None, None, None),
    (1, "d % 4 < 2", "p", "'TCK' || d", None, None, None),
    (2, "d % 4 < 2", "p", "'  Annual review of document number ' || d", None, None, None),
    (3, "d % 4 < 2", "p", "'For the year of ' || d", None, None, None),
    (4, "d % 4 < 2", "t", "''", 4, 2, None),
    (5, "d % 4 = 0", "t", f"'Notice: {K.DISCLAIMER_TEXT}.'", 1, 1, None),
    (6, "d % 4 <> 1", "p", f"'{K.TOC_TITLE}'", None, None, None),
    (7, "d % 4 <> 1", "p", "'field'", None, None, None),
    (8, "d % 4 <> 1", "p", "'x' || d", None, None, "TOC1"),
    (9, "d % 4 <> 1", "p", f"'Press {K.TOC_NOTE} now'", None, None, None),
    (TAIL, "true", "p", f"'{K.ENDNOTES_TITLE}'", None, None, None),
    (TAIL + 1, "true", "p", "'1 first of ' || d", None, None, None),
    (TAIL + 2, "true", "p", "'2 second of ' || d", None, None, None),
    (TAIL + 3, "true", "p", "'no note'", None, None, None),
    (TAIL + 4, "true", "p", "'2 third of ' || d", None, None, None),
    (TAIL + 5, "true", "p", f"'{K.DISCLAIMER_TITLE}'", None, None, None),
    (TAIL + 6, "true", "p", "'closing words'", None, None, None),
]


def _doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(f"o_orderkey DIV {DOC_SIZE} AS d").distinct()


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover, body and tail of every document."""
    rows = ", ".join(
        f"CASE WHEN {cond} THEN named_struct('block_idx', CAST({pos} AS BIGINT), 'kind', '{kind}', 'text', {text}, "
        f"'style_id', CAST({'NULL' if style is None else repr(style)} AS STRING), "
        f"'n_rows', CAST({'NULL' if r is None else r} AS INT), 'n_cols', CAST({'NULL' if c is None else c} AS INT)) END"
        for pos, cond, kind, text, r, c, style in _EXTRA
    )
    extra = _doc_ids(spark, sf_dir).selectExpr("d AS doc_id", f"explode(array({rows})) AS b").filter("b IS NOT NULL")
    extra = extra.selectExpr(
        "doc_id", "b.block_idx", "b.kind", "b.text", "b.style_id", "CAST(NULL AS STRING) AS num_id", "CAST(NULL AS INT) AS ilvl",
        "CAST(NULL AS DOUBLE) AS left_indent_pt", "false AS all_bold", "CAST(NULL AS INT) AS outline_lvl", "b.n_rows", "b.n_cols",
        "CAST(NULL AS STRING) AS fill", "CAST(NULL AS STRING) AS bookmark", "false AS has_object",
    )
    return body(spark, sf_dir).unionByName(extra)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the metadata panels."""
    rows = ["('Report Date', '2026-01-01')", "('Prepared By', 'A' || d)", "(' institution', 'Company ' || d)", "('Sector', 'SECTOR ' || d)"]
    pairs = ", ".join(f"struct{r}" for r in rows)
    return _doc_ids(spark, sf_dir).filter("d % 4 < 2").selectExpr("d AS doc_id", f"posexplode(array({pairs})) AS (row_idx, p)").selectExpr(
        "doc_id", "CAST(4 AS BIGINT) AS block_idx", "row_idx", "posexplode(array(p.col1, p.col2)) AS (col_idx, text)"
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the end-note paragraphs."""
    notes = [(1, "1", "first"), (2, "2", "second"), (4, "2", "third")]
    rows = ", ".join(
        f"struct(CAST({TAIL + pos} AS BIGINT), {i}, {text}, {sup})"
        for pos, num, word in notes
        for i, (text, sup) in enumerate([(f"'{num}'", "true"), ("' '", "false"), (f"'{word} of ' || d", "false")])
    )
    plain = f", struct(CAST({TAIL + 3} AS BIGINT), 0, 'no note', false)"
    return _doc_ids(spark, sf_dir).selectExpr("d AS doc_id", f"explode(array({rows}{plain})) AS r").selectExpr(
        "doc_id", "r.col1 AS block_idx", "r.col2 AS run_idx", "r.col3 AS text", "r.col4 AS superscript"
    )


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom properties: one per order, and the generator of some documents."""
    own = table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey DIV {DOC_SIZE} AS doc_id", "o_orderkey AS ord",
        """CASE o_orderkey % 6 WHEN 0 THEN 'Report Title' WHEN 1 THEN 'Company' WHEN 2 THEN ' report-date ' WHEN 3 THEN 'Custom Key ' || (o_orderkey DIV 6 % 3)
           WHEN 4 THEN 'Issuer' ELSE 'Prepared For' END AS name""",
        "'v' || o_orderkey AS value",
    )
    named = _doc_ids(spark, sf_dir).filter("d % 4 = 3").selectExpr(
        "d AS doc_id", "CAST(-1 AS BIGINT) AS ord", "'generator' AS name", "' Report Writer ' AS value"
    )
    return own.unionByName(named)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block ranges: single blocks, overlapping ranges, open ones, one over a whole document, empty ones."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS r", f"o_orderkey DIV {DOC_SIZE} AS doc_id", f"o_orderkey % {DOC_SIZE} + {BODY} AS i").selectExpr(
        "doc_id",
        """explode(filter(array(
          CASE WHEN r % 64 = 63 THEN named_struct('start_idx', i, 'end_idx', i + 1) END,
          CASE WHEN r % 128 IN (100, 105) THEN named_struct('start_idx', i, 'end_idx', i + 20) END,
          CASE WHEN r % 512 = 401 AND doc_id % 8 = 3 THEN named_struct('start_idx', i, 'end_idx', CAST(NULL AS BIGINT)) END,
          CASE WHEN r % 512 = 50 AND doc_id % 16 = 5 THEN named_struct('start_idx', CAST(-5 AS BIGINT), 'end_idx', 4611686018427387904) END,
          CASE WHEN r % 256 = 7 THEN named_struct('start_idx', i, 'end_idx', i) END), x -> x IS NOT NULL)) AS s""",
    ).select("doc_id", "s.start_idx", "s.end_idx")
