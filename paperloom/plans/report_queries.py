"""Queries over the report corpora: structure, runs, tables, metadata, notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as AU
from ..operators import footnotes as N
from ..operators import inline as I
from ..operators import math as MA
from ..operators import metadata as MD
from ..operators import render as R
from ..operators import structure as S
from ..operators import tables as T
from ..options import RenderOptions, SeparatorOptions
from . import corpora as C
from . import oracles as O
from .registry import query

KEY = ["doc_id", "block_idx"]


# --- lines and blocks ---------------------------------------------------------

@query(
    "split_lines",
    "SELECT doc_id, i - 1 AS line_no, lines[i] AS text FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))",
)
def split_lines(spark, sf_dir):
    return S.split_lines(C.documents(spark, sf_dir))


@query("frontmatter_span", O.with_(O.DOC) + "SELECT doc_id, CASE WHEN k % 2 = 0 THEN 6 ELSE 5 END AS n_lines, true AS is_valid FROM doc WHERE k % 3 = 0")
def frontmatter_span(spark, sf_dir):
    return S.frontmatter_span(C.reports(spark, sf_dir))


@query("frontmatter_valid", O.with_(O.DOC) + "SELECT doc_id, k % 3 = 0 AS is_valid FROM doc")
def frontmatter_valid(spark, sf_dir):
    return S.frontmatter_valid(C.reports(spark, sf_dir))


@query(
    "frontmatter_pairs",
    O.with_(O.DOC, O.META) + "SELECT doc_id, 0 AS pos, 'title' AS key, title AS value FROM meta WHERE k % 3 = 0 "
    "UNION ALL SELECT doc_id, 1, 'sector', seg FROM meta WHERE k % 3 = 0 "
    "UNION ALL SELECT doc_id, 2, 'desk', desk FROM meta WHERE k % 3 = 0",
)
def frontmatter_pairs(spark, sf_dir):
    return S.frontmatter_pairs(C.reports(spark, sf_dir))


#: The class of every line of a report after its metadata block, in the order of ``corpora._LINES`` from its seventh entry on;
#: ``*`` is one of two rules.
_CLASSES = (
    "E1E2E" "PEPEP" "PEPE" "BEP" "E2E" "PPE" "PPPE" "33E" "TTTTTT" "E" "QQE" "BBBBBBE" "NEhE*E" "F1TPPFE" "FPFE" "LEMPME" "GEWE" "PE" "RhhhE4"
)


def _line_classes() -> str:
    """``(doc_id, line_no, cls)``: the lines that a report has, counted in order."""
    head = "k % 3 = 0"
    rows = []
    for j, ((cond, line), cls) in enumerate(zip(C._LINES[6:], _CLASSES, strict=True)):
        shown = "CASE WHEN k % 2 = 0 THEN '-' ELSE '=' END" if cls == "*" else f"'{cls}'"
        times = ", unnest(range(0, n)) AS sub" if line is None else ", 0 AS sub"
        rows.append(f"SELECT k, {j} AS j{times}, {shown} AS cls FROM f WHERE {cond.replace('edited', 'false')}")
    counts = ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS p{i}" for i, p in enumerate(C.PRIORITIES))
    return f"""WITH f AS (SELECT o_custkey AS k, count(*) AS n, {counts} FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
    lines AS ({" UNION ALL ".join(rows)})
    SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY j, sub) - 1 + CASE WHEN {head} THEN 5 + CAST(k % 6 = 0 AS INT) ELSE 0 END AS INT) AS line_no, cls
    FROM lines"""


@query("classify_lines", _line_classes())
def classify_lines(spark, sf_dir):
    return S.classify_lines(C.reports(spark, sf_dir)).select("doc_id", "line_no", "cls")


@query("segment_blocks", O.typed("true", "doc_id, block_idx, type"))
def segment_blocks(spark, sf_dir):
    return S.segment_blocks(C.reports(spark, sf_dir)).select(*KEY, "type")


@query(
    "blocks",
    O.typed(
        "true",
        """doc_id, block_idx, type, level, text, CASE WHEN type = 'BLOCKQUOTE' THEN 'NOTE' END AS title,
        CASE WHEN type = 'NUMBERED_LIST' THEN '1' END AS number,
        CASE WHEN type IN ('BULLET_LIST', 'NUMBERED_LIST') THEN CAST(ord = 86 AS INT) END AS indent_level,
        CASE type WHEN 'CODE_BLOCK' THEN 'sql' WHEN 'DIAGRAM' THEN 'diagram:flow' END AS language,
        CASE WHEN type = 'IMAGE' THEN 'chart ' || k END AS alt_text,
        CASE WHEN type = 'IMAGE' THEN 'img/' || k || '.png' END AS path,
        type = 'NUMBERED_HEADING' AS is_numbered, type = 'CODE_BLOCK' AND k % 6 = 0 AS is_ascii_art,
        ord = 40 AS has_inline_latex""",
    ),
)
def blocks(spark, sf_dir):
    return S.blocks(C.reports(spark, sf_dir)).drop("raw", "start_line", "n_lines")


@query("headings", O.typed("type LIKE 'HEADING%' OR ord = 140", "doc_id, block_idx, type, level, text"))
def headings(spark, sf_dir):
    return S.headings(C.reports(spark, sf_dir))


@query("numbered_headings", O.typed("ord = 95", "doc_id, block_idx, 2 AS num, text"))
def numbered_headings(spark, sf_dir):
    return S.numbered_headings(C.reports(spark, sf_dir))


@query("separators", O.typed("type = 'SEPARATOR'", "doc_id, block_idx, CASE WHEN k % 2 = 1 THEN 'page-break' ELSE 'rule' END AS mode"))
def separators(spark, sf_dir):
    return S.separators(C.reports(spark, sf_dir))


@query("separators_forced", O.typed("type = 'SEPARATOR'", "doc_id, block_idx, 'page-break' AS mode"))
def separators_forced(spark, sf_dir):
    return S.separators(C.reports(spark, sf_dir), SeparatorOptions("page-break"))


@query("code_blocks", O.typed("type = 'CODE_BLOCK'", "doc_id, block_idx, 'sql' AS language, text"))
def code_blocks(spark, sf_dir):
    return S.code_blocks(C.reports(spark, sf_dir))


@query("ascii_art_flag", O.typed("type = 'CODE_BLOCK'", "doc_id, block_idx, k % 6 = 0 AS is_ascii_art"))
def ascii_art_flag(spark, sf_dir):
    return S.ascii_art_flag(C.reports(spark, sf_dir))


@query("diagram_blocks", O.typed("type = 'DIAGRAM'", "doc_id, block_idx, 'flow' AS diagram_type, text"))
def diagram_blocks(spark, sf_dir):
    return S.diagram_blocks(C.reports(spark, sf_dir))


@query("math_blocks", O.typed("type = 'LATEX_BLOCK'", "doc_id, block_idx, text"))
def math_blocks(spark, sf_dir):
    return S.math_blocks(C.reports(spark, sf_dir))


@query(
    "images",
    "SELECT p_partkey AS doc_id, p_name AS alt_text, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'img/' || p_partkey || '.png' END AS path, "
    "CASE WHEN p_partkey % 4 = 0 THEN 'image/png' WHEN p_partkey % 2 = 0 THEN 'image/jpeg' END AS mime, "
    "CASE WHEN p_partkey % 2 = 0 THEN base64(encode(p_name)) END AS data FROM part",
)
def images(spark, sf_dir):
    return S.images(C.pictures(spark, sf_dir)).drop("block_idx")


@query("callouts", O.typed("type = 'BLOCKQUOTE'", "doc_id, block_idx, 'NOTE' AS title, text"))
def callouts(spark, sf_dir):
    return S.callouts(C.reports(spark, sf_dir))


@query("bullet_items", O.typed("type = 'BULLET_LIST'", "doc_id, block_idx, CAST(ord = 86 AS INT) AS indent_level, text"))
def bullet_items(spark, sf_dir):
    return S.bullet_items(C.reports(spark, sf_dir))


@query("numbered_items", O.typed("type = 'NUMBERED_LIST'", "doc_id, block_idx, '1' AS number, 0 AS indent_level, text"))
def numbered_items(spark, sf_dir):
    return S.numbered_items(C.reports(spark, sf_dir))


@query("merge_paragraphs", O.typed("type = 'PARAGRAPH'", "doc_id, block_idx, text, ord = 40 AS has_inline_latex"))
def merge_paragraphs(spark, sf_dir):
    return S.merge_paragraphs(C.reports(spark, sf_dir))


@query(
    "normalize_inline_spacing",
    "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]{2,}', ' ', 'g'), "
    "'\\(\\s+', '(', 'g'), '\\s+\\)', ')', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents",
)
def normalize_inline_spacing(spark, sf_dir):
    return S.normalize_inline_spacing(C.documents(spark, sf_dir))


@query("strip_anchors", "SELECT doc_id, text || '-' || source AS text FROM documents")
def strip_anchors(spark, sf_dir):
    rows = C.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text || '<a class=\"x\" id=\"d' || doc_id || '\"> </a>-<A ID = \\'q\\'></A>' || source AS text"
    )
    return S.strip_html_anchors(rows)


@query("strip_anchors_pages", "SELECT page_id AS doc_id, html AS text FROM pages")
def strip_anchors_pages(spark, sf_dir):
    rows = C.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return S.strip_html_anchors(rows)


@query(
    "reference_gate",
    O.with_(O.DOC) + "SELECT doc_id, '## Sources' AS text FROM doc UNION ALL SELECT doc_id, '1. orders of ' || k FROM doc "
    "UNION ALL SELECT doc_id, '2. unused note' FROM doc UNION ALL SELECT doc_id, '2. last note ' || k FROM doc WHERE k % 2 = 1 "
    "UNION ALL SELECT doc_id, '' FROM doc",
)
def reference_gate(spark, sf_dir):
    return S.reference_gate(C.reports(spark, sf_dir)).select("doc_id", "text")


@query(
    "assign_sections",
    O.BASE + """, h AS (SELECT doc_id, ord, level, text FROM blk WHERE level IS NOT NULL)
    SELECT b.doc_id, b.block_idx,
      (SELECT arg_max(h.text, h.ord) FROM h WHERE h.doc_id = b.doc_id AND h.ord <= b.ord) AS heading,
      CASE WHEN b.ord < 11 OR k % 3 = 0 AND b.ord < 30 THEN c_name || ' - order report'
        WHEN b.ord < 30 THEN c_name || ' - order report > Segment ' || seg
        WHEN b.ord < 50 THEN c_name || ' - order report > 1. Overview'
        WHEN b.ord < 95 THEN c_name || ' - order report > 1. Overview > Detail'
        WHEN b.ord < 140 THEN c_name || ' - order report > 2. Closing remarks'
        WHEN k % 2 = 1 THEN c_name || ' - order report > 2. Closing remarks'
        WHEN b.ord < 160 THEN '**7. Annex ' || k || '**'
        ELSE '**7. Annex ' || k || '** > Appendix ' || k END AS path
    FROM blk b JOIN (SELECT doc_id, c_name, seg FROM doc) d USING (doc_id)""",
)
def assign_sections(spark, sf_dir):
    rows = S.blocks(C.reports(spark, sf_dir)).select(*KEY, "level", "text")
    return S.assign_sections(rows)


@query(
    "outline",
    O.BASE + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS entry_no, level, text FROM blk WHERE level IS NOT NULL",
)
def outline(spark, sf_dir):
    return S.outline(C.reports(spark, sf_dir))


# --- runs -----------------------------------------------------------------------

def _paragraphs(spark, sf_dir):
    return S.merge_paragraphs(C.reports(spark, sf_dir)).select(*KEY, "text")


@query("color_spans", O.typed("ord = 41", "doc_id, block_idx, 1 AS pos, 'tint ' || k AS text, '#A1B2C3' AS color_hex"))
def color_spans(spark, sf_dir):
    return I.color_spans(_paragraphs(spark, sf_dir), KEY)


@query("inline_math", O.typed("ord = 40", "doc_id, block_idx, 0 AS pos, 'x_' || k AS expression"))
def inline_math(spark, sf_dir):
    return I.inline_math(_paragraphs(spark, sf_dir), KEY)


@query("inline_runs", O.with_(O.DOC, O.BLK, O.RUNS) + "SELECT * FROM runs")
def inline_runs(spark, sf_dir):
    spans = S.segment_blocks(C.reports(spark, sf_dir))
    return I.block_runs(spans.filter("code <> 'T'")).drop("row_idx", "col_idx")


@query(
    "plain_runs",
    O.with_(O.DOC, O.BLK, O.RUNS)
    + "SELECT doc_id, block_idx, run_idx, CASE WHEN ord = 40 AND run_idx = 6 THEN ' and $x_' || k || '$.' ELSE r.text END AS text, bold, italic, superscript "
    "FROM runs r JOIN (SELECT doc_id, block_idx, k, ord FROM blk WHERE type = 'PARAGRAPH') USING (doc_id, block_idx) WHERE NOT (ord = 40 AND run_idx > 6)",
)
def plain_runs(spark, sf_dir):
    return I.plain_runs(_paragraphs(spark, sf_dir), KEY).select(*KEY, "run_idx", "text", "bold", "italic", "superscript")


@query(
    "cell_runs",
    O.TABLES + "SELECT doc_id, block_idx, row_idx, col_idx, 0 AS run_idx, text FROM cell WHERE text <> ''",
)
def cell_runs(spark, sf_dir):
    spans = S.segment_blocks(C.reports(spark, sf_dir)).filter("code = 'T'")
    return I.block_runs(spans).select(*KEY, "row_idx", "col_idx", "run_idx", "text")


_UNESCAPED = """regexp_replace(text, '\\\\([~.*"''()\\[\\]{}|_-])', '\\1', 'g')"""


@query(
    "unescape_text",
    f"SELECT doc_id, {_UNESCAPED} AS text_spaced, trim({_UNESCAPED}, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents",
)
def unescape_text(spark, sf_dir):
    return I.unescape_text(C.documents(spark, sf_dir), ["doc_id"])


@query(
    "run_counts",
    O.with_(O.DOC, O.BLK, O.RUNS) + "SELECT doc_id, block_idx, count(*) FILTER (bold) AS bold_runs, count(*) FILTER (italic) AS italic_runs FROM runs GROUP BY 1, 2 "
    "UNION ALL SELECT doc_id, block_idx, 0, 0 FROM blk WHERE type = 'TABLE'",
)
def run_counts(spark, sf_dir):
    return I.run_counts(S.segment_blocks(C.reports(spark, sf_dir)))


# --- tables -----------------------------------------------------------------------

def _spans(spark, sf_dir):
    return S.segment_blocks(C.reports(spark, sf_dir))


@query(
    "table_rows",
    O.TABLES + "SELECT t.doc_id, block_idx, row_idx, array_to_string(list_filter(cells, lambda c: c <> ''), '|') || "
    "CASE WHEN t.cells[2] = 'Z' THEN '|extra ' || t.k ELSE '' END AS cells FROM trow t JOIN tbl USING (doc_id)",
)
def table_rows(spark, sf_dir):
    return T.table_rows(_spans(spark, sf_dir)).withColumn("cells", F.array_join("cells", "|"))


@query(
    "tables",
    O.TABLES + "SELECT doc_id, block_idx, table_type, n_cols, n_rows, CASE WHEN k % 17 = 0 THEN 'left,left,left,left' ELSE 'left,center,right,left' END AS alignments "
    "FROM tbl JOIN nrow USING (doc_id)",
)
def tables(spark, sf_dir):
    return T.tables(_spans(spark, sf_dir))


@query("column_alignments", O.TABLES + "SELECT doc_id, block_idx, col_idx, alignment FROM cell WHERE row_idx = 0")
def column_alignments(spark, sf_dir):
    return T.column_alignments(_spans(spark, sf_dir))


@query("classify_table", O.TABLES + "SELECT doc_id, block_idx, table_type FROM tbl")
def classify_table(spark, sf_dir):
    return T.classify_table(_spans(spark, sf_dir))


@query("table_shape", O.TABLES + "SELECT doc_id, block_idx, n_rows, n_cols FROM tbl JOIN nrow USING (doc_id)")
def table_shape(spark, sf_dir):
    return T.table_shape(_spans(spark, sf_dir))


_HAS_DIGIT = "regexp_matches(text, '[0-9]')"
_CELL_FLAGS = {
    "is_numeric": f"col_idx > 0 AND {_HAS_DIGIT}",
    "is_negative": f"(starts_with(text, '-') OR starts_with(text, '(') AND ends_with(text, ')')) AND {_HAS_DIGIT}",
    "is_base_case": "table_type = 'BEP_SENSITIVITY' AND row_idx = n_rows // 2 AND col_idx = 2 AND row_idx > 0",
    "risk_level": "CASE WHEN table_type = 'RISK_MATRIX' AND col_idx = 2 AND text IN ('High', 'Medium', 'Low') THEN lower(text) END",
}


@query(
    "table_cells",
    O.TABLES + "SELECT doc_id, block_idx, row_idx, col_idx, text, alignment, table_type, row_idx = 0 AS is_header, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _CELL_FLAGS.items()) + " FROM cell",
)
def table_cells(spark, sf_dir):
    return T.table_cells(_spans(spark, sf_dir))


def _flag_query(name: str, title: str) -> None:
    sql = O.TABLES + f"SELECT doc_id, block_idx, row_idx, col_idx, {_CELL_FLAGS[name]} AS {name} FROM cell"

    @query(title, sql)
    def run(spark, sf_dir):
        return T.table_cells(_spans(spark, sf_dir)).select(*KEY, "row_idx", "col_idx", name)


_flag_query("is_numeric", "cell_is_numeric")
_flag_query("is_negative", "cell_is_negative")
_flag_query("is_base_case", "cell_is_base_case")
_flag_query("risk_level", "cell_risk_level")


@query(
    "dropped_cells",
    O.TABLES + "SELECT doc_id, block_idx, row_idx, 4 AS col_idx, 'extra ' || t.k AS text FROM trow t JOIN tbl USING (doc_id) WHERE cells[2] = 'Z'",
)
def dropped_cells(spark, sf_dir):
    return T.dropped_cells(_spans(spark, sf_dir))


_SHOWN = O.TABLES.rstrip() + f""", shown AS (
  SELECT *, {O.FORMATTED} AS display FROM cell),
body AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_idx, col_idx ORDER BY row_idx) AS rn
         FROM shown WHERE row_idx > 0 AND display <> ''),
kinds AS (
  SELECT doc_id, block_idx, col_idx, CASE WHEN
    count(*) FILTER (regexp_matches(display, '^\\(?[+-]?[0-9][0-9,]*(\\.[0-9]+)?\\)?$')) >= (count(*) + 1) // 2
    THEN 'numeric' ELSE 'text' END AS kind FROM body WHERE rn <= 3 GROUP BY 1, 2, 3),
lens AS (
  SELECT doc_id, block_idx, col_idx, list_sort(list(length(display))) AS l,
         max(CASE WHEN display = 'Revenue 2025' THEN 7 ELSE length(display) END) AS longest_token
  FROM shown WHERE display <> '' GROUP BY 1, 2, 3),
prof AS (
  SELECT doc_id, block_idx, col_idx, kind, longest_token,
         l[CAST(round_even((len(l) - 1) * 0.75, 0) AS INT) + 1] AS rep FROM lens JOIN kinds USING (doc_id, block_idx, col_idx))
"""


@query("column_kinds", _SHOWN + "SELECT doc_id, block_idx, col_idx, kind FROM kinds")
def column_kinds(spark, sf_dir):
    return T.column_kinds(_spans(spark, sf_dir))


@query(
    "column_profile",
    _SHOWN + "SELECT doc_id, block_idx, col_idx, kind, rep AS representative_length, longest_token, "
    "CAST(round(CASE kind WHEN 'numeric' THEN 1.0 + least(rep, 12) * 0.05 ELSE 1.8 + least(rep, 48) * 0.06 + least(longest_token, 24) * 0.03 END * 100) AS BIGINT) AS score_100 FROM prof",
)
def column_profile(spark, sf_dir):
    out = T.column_profile(_spans(spark, sf_dir))
    return out.withColumn("score_100", F.round(F.col("score") * 100).cast("bigint")).drop("score")


@query("financial_cells", _SHOWN + "SELECT doc_id, block_idx, row_idx, col_idx, display AS display_text FROM shown")
def financial_cells(spark, sf_dir):
    return T.financial_cells(T.table_cells(_spans(spark, sf_dir)))


_UNITS = "CASE o_orderkey % 6 WHEN 0 THEN '%' WHEN 1 THEN '억' WHEN 2 THEN ' 원' WHEN 3 THEN 'kg' WHEN 4 THEN 'BP' ELSE '' END"


def _amounts(spark, sf_dir):
    """Order totals in many spellings."""
    price = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
    return C.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        f"CASE o_orderkey % 4 WHEN 0 THEN {price} || {_UNITS} WHEN 1 THEN '(' || CAST(o_custkey AS STRING) || '000)' || {_UNITS} "
        f"WHEN 2 THEN '-' || {price} || {_UNITS} ELSE o_orderpriority END AS text",
    )


@query(
    "is_numeric_like",
    "SELECT o_orderkey, o_orderkey % 4 <> 3 AND o_orderkey % 6 <> 3 AS is_numeric_like FROM orders",
)
def is_numeric_like(spark, sf_dir):
    return T.numeric_like(_amounts(spark, sf_dir), ["o_orderkey"])


_CENTS = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"
_GROUPED = f"format('{{:,}}', CAST(split_part({_CENTS}, '.', 1) AS BIGINT)) || '.' || split_part({_CENTS}, '.', 2)"


@query(
    "format_financial",
    f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {_GROUPED} || {_UNITS} "
    f"WHEN 1 THEN '(' || format('{{:,}}', o_custkey * 1000) || ')' || {_UNITS} "
    f"WHEN 2 THEN '-' || {_GROUPED} || {_UNITS} ELSE o_orderpriority END AS formatted FROM orders",
)
def format_financial(spark, sf_dir):
    return T.format_financial(_amounts(spark, sf_dir), ["o_orderkey"])


# --- metadata ---------------------------------------------------------------------

@query("document_metadata", O.with_(O.DOC, O.META) + O.PARSED_META)
def document_metadata(spark, sf_dir):
    return MD.metadata_entries(MD.document_metadata(C.reports(spark, sf_dir)))


@query("infer_metadata", O.with_(O.DOC, O.META) + O.INFERRED_META)
def infer_metadata(spark, sf_dir):
    return MD.metadata_entries(MD.infer_metadata(C.reports(spark, sf_dir)))


@query(
    "header_metadata",
    O.with_(O.DOC, O.META) + "SELECT doc_id, 'title' AS role, '' AS key, title AS value FROM meta WHERE k % 3 <> 0 "
    "UNION ALL SELECT doc_id, 'subtitle', '', subtitle FROM meta WHERE k % 3 <> 0 "
    "UNION ALL SELECT doc_id, 'extra', 'Report date', last_day FROM meta WHERE k % 3 <> 0 "
    "UNION ALL SELECT doc_id, 'extra', 'Sector', seg FROM meta WHERE k % 3 <> 0",
)
def header_metadata(spark, sf_dir):
    return MD.header_metadata(C.reports(spark, sf_dir))


@query("body_blocks", O.typed("in_body", "doc_id, block_idx, type"))
def body_blocks(spark, sf_dir):
    return S.body_blocks(C.reports(spark, sf_dir)).select(*KEY, "type")


@query(
    "leading_label_pair",
    O.with_(O.DOC, O.BLK) + """SELECT doc_id, block_idx,
      CASE WHEN ord IN (22, 23) THEN 'Recipient' WHEN ord = 20 THEN CASE WHEN b.k % 3 = 0 THEN '작성자' ELSE 'Report date' END
           WHEN b.k % 3 = 0 THEN 'As of' ELSE 'Sector' END AS label,
      CASE WHEN ord IN (22, 23) THEN 'Desk ' || (b.k % 5) WHEN ord = 20 THEN CASE WHEN b.k % 3 = 0 THEN 'Analyst ' || (b.k % 4) ELSE last_day END
           WHEN b.k % 3 = 0 THEN last_day ELSE ': ' || seg END AS value
      FROM blk b JOIN doc USING (doc_id) WHERE ord BETWEEN 20 AND 23 AND type = 'PARAGRAPH'""",
)
def leading_label_pair(spark, sf_dir):
    return MD.leading_label_pairs(_paragraphs(spark, sf_dir))


@query("subject_from_title", O.with_(O.DOC) + "SELECT doc_id, c_name AS subject FROM doc")
def subject_from_title(spark, sf_dir):
    return MD.subject_from_title(MD.document_metadata(C.reports(spark, sf_dir)))


@query(
    "meaningful_metadata",
    O.with_(O.DOC, O.META) + "SELECT doc_id, 0 AS position, 'Report Date' AS label, last_day AS value FROM meta WHERE k % 3 = 0 "
    "UNION ALL SELECT doc_id, 3, 'Prepared By', 'Analyst ' || (k % 4) FROM meta WHERE k % 3 = 0 "
    "UNION ALL SELECT doc_id, 5, 'Sector', sector FROM meta WHERE k % 3 = 0 "
    "UNION ALL SELECT doc_id, 6, 'Prepared For', 'Desk ' || (k % 5) FROM meta WHERE k % 3 <> 2",
)
def meaningful_metadata(spark, sf_dir):
    return MD.meaningful_metadata(MD.infer_metadata(C.reports(spark, sf_dir)))


@query("frontmatter_text", O.with_(O.DOC, O.META) + f"SELECT doc_id, {O.FRONT} || chr(10) AS frontmatter FROM meta")
def frontmatter_text(spark, sf_dir):
    return MD.frontmatter_text(C.reports(spark, sf_dir))


# --- footnotes ----------------------------------------------------------------------

def _notes_and_refs(spark, sf_dir):
    corpus = C.reports(spark, sf_dir)
    refs = N.superscript_refs(S.segment_blocks(corpus))
    return refs.select(*KEY, "run_idx", "num"), N.footnote_defs(corpus)


@query("footnote_defs", O.with_(O.DOC, O.NOTES) + "SELECT doc_id, num, text FROM notes")
def footnote_defs(spark, sf_dir):
    return N.footnote_defs(C.reports(spark, sf_dir))


@query("footnote_refs", O.typed("ord = 40", "doc_id, block_idx, 5 AS run_idx, 1 AS num"))
def footnote_refs(spark, sf_dir):
    return _notes_and_refs(spark, sf_dir)[0]


@query(
    "footnote_marks",
    O.with_(O.DOC, O.BLK) + "SELECT doc_id, block_idx, 0 AS pos, CASE ord WHEN 40 THEN 1 WHEN 150 THEN 2 ELSE CAST(split_part(acct, '.', 2) AS INT) END AS num "
    "FROM blk JOIN doc USING (doc_id) WHERE ord IN (40, 41, 150)",
)
def footnote_marks(spark, sf_dir):
    return N.footnote_marks(_paragraphs(spark, sf_dir), KEY)


@query("resolve_footnotes", O.typed("ord = 40", "doc_id, block_idx, 5 AS run_idx, 1 AS num, 'orders of ' || k AS note"))
def resolve_footnotes(spark, sf_dir):
    return N.resolve_footnotes(*_notes_and_refs(spark, sf_dir))


@query("kept_notes", O.with_(O.DOC) + "SELECT doc_id, 1 AS num, 'orders of ' || k AS text, true AS is_native FROM doc")
def kept_notes(spark, sf_dir):
    return N.kept_notes(*_notes_and_refs(spark, sf_dir))


@query(
    "dangling_refs",
    # the cents of a balance read as a mark; they dangle unless a note has that number
    O.with_(O.DOC, O.BLK) + "SELECT doc_id, block_idx, 0 AS pos, CAST(split_part(acct, '.', 2) AS INT) AS num "
    "FROM blk JOIN doc USING (doc_id) WHERE ord = 41 AND CAST(split_part(acct, '.', 2) AS INT) NOT IN (1, 2)",
)
def dangling_refs(spark, sf_dir):
    refs = N.footnote_marks(_paragraphs(spark, sf_dir), KEY)
    return N.dangling_refs(refs, N.footnote_defs(C.reports(spark, sf_dir))).select(*KEY, "pos", "num")


@query("unused_notes", O.with_(O.DOC, O.NOTES) + "SELECT doc_id, num, text FROM notes WHERE num = 2")
def unused_notes(spark, sf_dir):
    return N.unused_notes(*_notes_and_refs(spark, sf_dir))


@query(
    "endnotes_text",
    O.with_(O.DOC, O.NOTES) + "SELECT doc_id, '## Citations' || chr(10) || string_agg(num || '. ' || text, chr(10) ORDER BY num) || chr(10) AS endnotes FROM notes GROUP BY 1",
)
def endnotes_text(spark, sf_dir):
    return N.endnotes_text(C.reports(spark, sf_dir))


# --- rendering ------------------------------------------------------------------------

_MD = O.TABLES.rstrip() + ",\n" + O.TABLE_MD + "\n"


def _rendered(codes: str, name: str, where: str) -> None:
    @query(name, _MD + f"SELECT doc_id, block_idx, markdown FROM md WHERE {where}")
    def run(spark, sf_dir):
        spans = _spans(spark, sf_dir).filter(F.contains(F.lit(codes), F.col("code")))
        return R.render_blocks(spans).drop("code")


_rendered("1234Wh", "render_heading", "type LIKE '%HEADING%'")
_rendered("P", "render_paragraph", "type = 'PARAGRAPH'")
_rendered("T", "render_table", "type = 'TABLE'")
_rendered("BN", "render_list", "type IN ('BULLET_LIST', 'NUMBERED_LIST')")
_rendered("Q", "render_callout", "type = 'BLOCKQUOTE'")
_rendered("FDLM-=", "render_code_math_separator", "type IN ('CODE_BLOCK', 'DIAGRAM', 'LATEX_BLOCK', 'SEPARATOR')")


@query(
    "render_runs",
    O.with_(O.DOC, O.BLK, O.RUNS) + """SELECT doc_id, block_idx, string_agg(
      CASE WHEN bold THEN '**' || text || '**' WHEN italic THEN '*' || text || '*' WHEN superscript THEN '^' || text || '^'
           WHEN subscript THEN '~' || text || '~' WHEN color_hex IS NOT NULL THEN '<span style="color:' || color_hex || '">' || text || '</span>'
           ELSE text END, '' ORDER BY run_idx) AS markdown FROM runs GROUP BY 1, 2""",
)
def render_runs(spark, sf_dir):
    from ..functions.render import render_runs as render

    runs = I.block_runs(_spans(spark, sf_dir).filter("code <> 'T'"))
    # runs of one block only: bounded by the block's text
    grouped = runs.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("run_idx", *I.RUN_FIELDS))).alias("r")
    )
    return grouped.select(*KEY, render(F.col("r")).alias("markdown"))


@query(
    "strip_formatting",
    O.with_(O.DOC, O.BLK, O.RUNS) + "SELECT doc_id, block_idx, string_agg(text, '' ORDER BY run_idx) AS markdown FROM runs "
    "WHERE (doc_id, block_idx) IN (SELECT doc_id, block_idx FROM blk WHERE type = 'PARAGRAPH') GROUP BY 1, 2",
)
def strip_formatting(spark, sf_dir):
    spans = _spans(spark, sf_dir).filter("code = 'P'")
    return R.render_blocks(spans, RenderOptions(strip_formatting=True)).drop("code")


@query(
    "render_image",
    "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 = 0 THEN '![' || p_name || '](data:image/png;base64,' || base64(encode(p_name)) || ')' "
    "WHEN p_partkey % 2 = 0 THEN '![' || p_name || '](data:image/jpeg;base64,' || base64(encode(p_name)) || ')' "
    "ELSE '![' || p_name || '](assets/pics/img/' || p_partkey || '.png)' END AS markdown FROM part",
)
def render_image(spark, sf_dir):
    options = RenderOptions(embed_images_base64=True, image_path_prefix="assets\\pics/")
    return R.render_blocks(S.segment_blocks(C.pictures(spark, sf_dir)), options).select("doc_id", "markdown")


@query(
    "render_image_plain",
    "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN '<!-- Image: ' || p_name || ' (path not available) -->' "
    "ELSE '![' || p_name || '](img/' || p_partkey || '.png)' END AS markdown FROM part",
)
def render_image_plain(spark, sf_dir):
    return R.render_blocks(S.segment_blocks(C.pictures(spark, sf_dir))).select("doc_id", "markdown")


_DOCUMENT = (
    O.with_(O.DOC, O.BLK, O.TROW, O.TABLE_MD, O.META, O.NOTES)
    + f""", parts AS (
      SELECT doc_id, -1 AS o, {O.FRONT} AS part FROM meta
      UNION ALL SELECT doc_id, ord, markdown FROM md WHERE in_body
      UNION ALL SELECT doc_id, 1000, '## Citations' || chr(10) || string_agg(num || '. ' || text, chr(10) ORDER BY num) FROM notes GROUP BY 1)
    SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY o) || chr(10) AS markdown FROM parts GROUP BY 1"""
)


@query("assemble_documents", _DOCUMENT)
def assemble_documents(spark, sf_dir):
    return R.assemble_documents(C.reports(spark, sf_dir))


@query("assemble_from_blocks", _DOCUMENT)
def assemble_from_blocks(spark, sf_dir):
    corpus = C.reports(spark, sf_dir)
    return R.assemble_from_blocks(
        R.render_blocks(S.body_blocks(corpus)), MD.frontmatter_text(corpus), N.endnotes_text(corpus)
    )


@query(
    "normalize_markdown",
    "SELECT s_suppkey AS doc_id, 'intro ' || s_suppkey || chr(10) || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10) || 'mid' "
    "|| chr(10) || chr(10) || '```sql' || chr(10) || '| x |' || chr(10) || chr(10) || chr(10) || chr(10) || 'y' || chr(10) || '```' || chr(10) || chr(10) || 'tail' || chr(10) AS text FROM supplier",
)
def normalize_markdown(spark, sf_dir):
    nl = "chr(10)"
    rows = C.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS doc_id",
        f"{nl} || 'intro ' || s_suppkey || '  ' || {nl} || '| a | b |' || {nl} || '| 1 | 2 |' || {nl} || 'mid' || {nl} || '```sql' || {nl} "
        f"|| '| x |  ' || {nl} || {nl} || {nl} || {nl} || 'y' || {nl} || '```' || {nl} || 'tail' || {nl} || {nl} || {nl} AS text",
    )
    return R.normalize_documents(rows)


# --- audit ------------------------------------------------------------------------------

_SUMMARY_TEXT = (
    "CASE type WHEN 'BLOCKQUOTE' THEN 'NOTE: ' || text WHEN 'SEPARATOR' THEN '---' WHEN 'DIAGRAM' THEN 'D' || k ELSE coalesce(text, '') END"
)


@query(
    "block_summary",
    O.TABLES.rstrip() + f", {O.RUNS}, rc AS (SELECT doc_id, block_idx, count(*) FILTER (bold) AS b, count(*) FILTER (italic) AS i FROM runs GROUP BY 1, 2) "
    f"""SELECT b.doc_id, b.block_idx, type, {_SUMMARY_TEXT} AS text, level, CASE WHEN type = 'CODE_BLOCK' THEN 'sql' ELSE '' END AS language,
      CASE WHEN type = 'TABLE' THEN n_rows END AS row_count, CASE WHEN type = 'TABLE' THEN 4 END AS column_count,
      CASE WHEN type = 'IMAGE' THEN 'chart ' || k ELSE '' END AS alt_text,
      CASE WHEN type IN ('BULLET_LIST', 'NUMBERED_LIST') THEN CAST(ord = 86 AS INT) END AS list_depth,
      CASE type WHEN 'BULLET_LIST' THEN 'bullet' WHEN 'NUMBERED_LIST' THEN 'decimal' ELSE '' END AS numbering_format,
      coalesce(rc.b, 0) AS bold_run_count, coalesce(rc.i, 0) AS italic_run_count,
      CASE WHEN type = 'DIAGRAM' THEN 'flow' ELSE '' END AS diagram_type, 0 AS box_count, 0 AS arrow_count
      FROM blk b JOIN nrow USING (doc_id) LEFT JOIN rc USING (doc_id, block_idx) WHERE in_body""",
)
def block_summary(spark, sf_dir):
    return AU.block_summary(S.body_blocks(C.reports(spark, sf_dir)))


@query("block_counts", O.BASE + "SELECT doc_id, type, count(*) AS n FROM blk WHERE in_body GROUP BY 1, 2")
def block_counts(spark, sf_dir):
    return AU.block_counts(S.body_blocks(C.reports(spark, sf_dir)))


@query(
    "document_summary",
    O.with_(O.DOC, O.BLK, O.META) + "SELECT doc_id, title, subtitle, company, count(*) AS block_count, "
    "string_agg(text, ' | ' ORDER BY ord) FILTER (level IS NOT NULL) AS headings, 2 AS footnote_count, 1 AS image_count, 1 AS table_count "
    "FROM blk JOIN meta USING (doc_id) WHERE in_body GROUP BY 1, 2, 3, 4",
)
def document_summary(spark, sf_dir):
    return AU.document_summary(C.reports(spark, sf_dir))


@query(
    "normalize_compare_text",
    "SELECT doc_id, regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[ \\t]+', ' ', 'g') AS inline_text, "
    "trim(array_to_string(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: rtrim(x, ' ' || chr(9))), chr(10)), chr(10)) AS block_text FROM documents",
)
def normalize_compare_text(spark, sf_dir):
    return AU.normalize_compare_text(C.documents(spark, sf_dir), ["doc_id"])


def _pairs(spark, sf_dir, parts="all"):
    return AU.pair_versions(*C.versions(spark, sf_dir), parts)


@query(
    "metadata_diff",
    O.with_(O.DOC) + "SELECT doc_id, 'extra' AS scope, 'Sector' AS key, seg AS source, seg || 'X' AS target FROM doc WHERE k % 5 = 1 AND k % 3 <> 0",
)
def metadata_diff(spark, sf_dir):
    return AU.metadata_diff(_pairs(spark, sf_dir, "metadata"))


@query(
    "count_delta",
    O.with_(O.DOC) + "SELECT doc_id, 'SEPARATOR' AS name, -1 AS delta FROM doc WHERE k % 5 = 2 UNION ALL SELECT doc_id, 'HEADING_3', 1 FROM doc WHERE k % 5 = 4",
)
def count_delta(spark, sf_dir):
    return AU.count_delta(_pairs(spark, sf_dir, "counts"))


# Of two equal headings the alignment keeps the one next to the longer equal
# run, which is the one that follows, so the added one is the first.
_DIFF = O.BASE + """, pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM blk WHERE in_body)
  SELECT doc_id, CASE k % 5 WHEN 2 THEN 'removed' WHEN 3 THEN 'changed' ELSE 'added' END AS change,
    CASE WHEN k % 5 IN (2, 3) THEN i END AS source_index,
    CASE WHEN k % 5 IN (3, 4) THEN i END AS target_index,
    CASE WHEN k % 5 = 3 THEN 'text' ELSE '' END AS changed_fields
  FROM pos WHERE k % 5 = 2 AND ord = 100 OR k % 5 = 3 AND ord = 110 OR k % 5 = 4 AND ord = 50"""


@query("block_diff", _DIFF)
def block_diff(spark, sf_dir):
    return AU.block_diff(_pairs(spark, sf_dir)).drop("change_no", "source", "target")


@query(
    "changed_fields",
    O.with_(O.DOC) + "SELECT doc_id, 'text' AS changed_fields FROM doc WHERE k % 5 = 3",
)
def changed_fields(spark, sf_dir):
    return AU.block_diff(_pairs(spark, sf_dir)).filter("change = 'changed'").select("doc_id", "changed_fields")


@query(
    "audit_status",
    O.with_(O.DOC) + "SELECT doc_id, CASE WHEN k % 5 = 0 OR k % 5 = 1 AND k % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM doc",
)
def audit_status(spark, sf_dir):
    return AU.audit_status(_pairs(spark, sf_dir, "status"))


@query(
    "audit_totals",
    O.with_(O.DOC) + "SELECT CASE WHEN k % 5 = 0 OR k % 5 = 1 AND k % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS documents FROM doc GROUP BY 1",
)
def audit_totals(spark, sf_dir):
    return AU.audit_totals(AU.audit_status(_pairs(spark, sf_dir, "status")))


@query(
    "audit_report",
    O.BASE + """, pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM blk WHERE in_body)
    SELECT doc_id, CASE WHEN k % 5 = 0 OR k % 5 = 1 AND k % 3 = 0 THEN 'Status: PASS' || chr(10) || 'No semantic differences detected.'
      WHEN k % 5 = 1 THEN 'Status: FAIL' || chr(10) || 'Metadata extra:' || chr(10) || '  - Sector: ' || seg || ' -> ' || seg || 'X'
      WHEN k % 5 = 2 THEN 'Status: FAIL' || chr(10) || 'Element count deltas: {''SEPARATOR'': -1}' || chr(10) || 'Changed elements:' || chr(10)
        || '  - removed: src#' || sep || ':SEPARATOR -> rt#<missing>' || chr(10) || '    text: --- -> <missing>'
      WHEN k % 5 = 3 THEN 'Status: FAIL' || chr(10) || 'Changed elements:' || chr(10) || '  - changed: src#' || code || ':CODE_BLOCK -> rt#' || code
        || ':CODE_BLOCK fields=text' || chr(10) || '    text: ' || replace(ct, chr(10), '\\n') || ' -> '
        || replace(replace(ct, 'heading ' || k, 'heading ' || k || ' changed'), chr(10), '\\n')
      ELSE 'Status: FAIL' || chr(10) || 'Element count deltas: {''HEADING_3'': 1}' || chr(10) || 'Changed elements:' || chr(10)
        || '  - added: src#<missing> -> rt#' || det || ':HEADING_3' || chr(10) || '    text: <missing> -> Detail' END AS report
    FROM (SELECT doc_id, any_value(pos.k) AS k, any_value(seg) AS seg, max(i) FILTER (ord = 100) AS sep, max(i) FILTER (ord = 110) AS code, max(i) FILTER (ord = 50) AS det,
          max(text) FILTER (ord = 110) AS ct FROM pos JOIN (SELECT doc_id, seg FROM doc) USING (doc_id) GROUP BY 1)""",
)
def audit_report(spark, sf_dir):
    return AU.audit_report(_pairs(spark, sf_dir))


@query(
    "audit_json",
    O.BASE + """, pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM blk WHERE in_body)
    SELECT doc_id, CASE WHEN k % 5 = 0 OR k % 5 = 1 AND k % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS status, 0 AS fields,
      CASE WHEN k % 5 = 1 AND k % 3 <> 0 THEN 'Sector:' || seg || '>' || seg || 'X' ELSE '' END AS extra,
      CASE k % 5 WHEN 2 THEN 'SEPARATOR-1' WHEN 4 THEN 'HEADING_31' ELSE '' END AS counts,
      CASE k % 5 WHEN 2 THEN 'removed ' || sep || ' - SEPARATOR/--- ' WHEN 3 THEN 'changed ' || code || ' ' || code || ' text CODE_BLOCK/' || ct || ' CODE_BLOCK/'
        || replace(ct, 'heading ' || k, 'heading ' || k || ' changed') WHEN 4 THEN 'added - ' || det || '  HEADING_3/Detail' ELSE '' END AS elements
    FROM (SELECT doc_id, any_value(pos.k) AS k, any_value(seg) AS seg, max(i) FILTER (ord = 100) AS sep, max(i) FILTER (ord = 110) AS code, max(i) FILTER (ord = 50) AS det,
          max(text) FILTER (ord = 110) AS ct FROM pos JOIN (SELECT doc_id, seg FROM doc) USING (doc_id) GROUP BY 1)""",
)
def audit_json(spark, sf_dir):
    block, pair = "struct<type: string, text: string>", "array<struct<key: string, source: string, target: string>>"
    schema = (
        f"status string, metadata_fields {pair}, metadata_extra {pair}, counts array<struct<name: string, delta: int>>, elements array<struct<"
        f"change: string, source_index: int, target_index: int, changed_fields: array<string>, source: {block}, target: {block}>>"
    )
    read = AU.audit_json(_pairs(spark, sf_dir)).select("doc_id", F.from_json("report", schema).alias("r"))
    shown = lambda b: F.coalesce(F.concat(b["type"], F.lit("/"), b["text"]), F.lit(""))
    number = lambda n: F.coalesce(n.cast("string"), F.lit("-"))
    fields = lambda e: F.when(e["change"] == "changed", F.array_join(e["changed_fields"], ","))
    element = lambda e: F.concat_ws(
        " ", e["change"], number(e["source_index"]), number(e["target_index"]), fields(e), shown(e["source"]), shown(e["target"])
    )
    return read.select(
        "doc_id", "r.status", F.size("r.metadata_fields").alias("fields"),
        F.array_join(F.transform("r.metadata_extra", lambda e: F.concat(e["key"], F.lit(":"), e["source"], F.lit(">"), e["target"])), ",").alias("extra"),
        F.array_join(F.transform("r.counts", lambda c: F.concat(c["name"], c["delta"].cast("string"))), ",").alias("counts"),
        F.array_join(F.transform("r.elements", element), ",").alias("elements"),
    )


@query(
    "roundtrip_corpus",
    O.with_(O.DOC, O.BLK) + "SELECT doc_id, CASE WHEN type = 'NUMBERED_HEADING' THEN 'HEADING_' || level ELSE type END AS type, count(*) AS n "
    "FROM blk WHERE in_body GROUP BY 1, 2",
)
def roundtrip_corpus(spark, sf_dir):
    again = R.roundtrip_corpus(C.reports(spark, sf_dir))
    return AU.block_counts(S.body_blocks(again))


@query(
    "roundtrip_stable",
    O.with_(O.DOC, O.BLK) + "SELECT doc_id, count(*) AS blocks, 'PASS' AS status, 'BLOCKQUOTE' AS changed FROM blk WHERE in_body GROUP BY 1",
)
def roundtrip_stable(spark, sf_dir):
    # after one normalising pass block types no longer change, nor do texts but those of callouts: they are written with a
    # bold title, which is read as text
    return AU.roundtrip_stable(R.roundtrip_corpus(C.reports(spark, sf_dir)))


# --- math -------------------------------------------------------------------------------

@query("equation_counts", O.with_(O.DOC) + "SELECT doc_id, 2 AS block_equations, 1 AS inline_equations FROM doc")
def equation_counts(spark, sf_dir):
    return MA.equation_counts(C.reports(spark, sf_dir))


@query(
    "latex_to_text",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '((total / ' || o_custkey || ') / ' || o_orderstatus || ') ≥ α × 5%' "
    "WHEN 1 THEN 'Δ' || o_orderkey || ' → ∞ √x (' || o_orderstatus || ')' ELSE '\\leftx ≈ ' || o_custkey END AS display FROM orders",
)
def latex_to_text(spark, sf_dir):
    b = "chr(92)"
    rows = C.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        f"CASE o_orderkey % 3 WHEN 0 THEN {b} || 'frac{{' || {b} || 'frac{{' || {b} || 'text{{total}}}}{{' || o_custkey || '}}}}{{' || {b} || 'mathrm{{' || o_orderstatus || '}}}}  ' "
        f"|| {b} || 'geq ' || {b} || 'alpha ' || {b} || 'times 5' || {b} || '%' "
        f"WHEN 1 THEN {b} || 'Delta' || o_orderkey || ' ' || {b} || 'to ' || {b} || 'infty ' || {b} || 'sqrt{{x}} ' || {b} || 'left(' || o_orderstatus || {b} || 'right)' "
        f"ELSE {b} || 'leftx ' || {b} || 'approx   ' || o_custkey END AS text",
    )
    return MA.latex_texts(rows, ["o_orderkey"])
