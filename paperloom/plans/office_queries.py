"""Queries over the office block tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import office as OF
from ..operators import office as W
from ..operators import office_flow as OW
from . import office_corpus as X
from .corpora import table
from .registry import query

D = X.DOC_SIZE
_R = f"SELECT o_orderkey AS r, o_orderkey // {D} AS doc_id, o_orderkey % {D} + {X.BODY} AS block_idx FROM orders"
_BODY = f"WITH b AS ({_R})\n"
_DOCS = f"WITH docs AS (SELECT DISTINCT o_orderkey // {D} AS d FROM orders)\n"
# level of a numbered paragraph, up to 10
_ILVL = "((r // 8) % 3 * CASE WHEN r % 7 = 0 THEN 5 ELSE 1 END)"
# number format of a numbered paragraph
_FMT = (
    f"CASE WHEN r % 8 IN (3, 7) AND r % 3 < 2 THEN CASE WHEN r % 5 < 3 THEN ['decimal', 'lowerLetter', 'lowerRoman'][{_ILVL} + 1] "
    f"ELSE ['bullet', 'upperRoman', NULL][{_ILVL} + 1] END END"
)
_LEVEL = (
    f"CASE WHEN r % 8 IN (3, 7) AND r % 3 < 2 THEN {_ILVL} WHEN r % 8 IN (0, 3) THEN 1 "
    "WHEN r % 8 = 7 THEN greatest(0, [0, 2, 2, 4][(r // 8) % 4 + 1] - 1) ELSE 0 END"
)


@query("style_chain", _BODY + "SELECT doc_id, block_idx, CASE r % 8 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 4 THEN 1 END AS level FROM b")
def style_chain(spark, sf_dir):
    levels = W.style_levels(X.styles(spark))
    return X.body(spark, sf_dir).join(levels, "style_id", "left").select("doc_id", "block_idx", "level")


@query(
    "heading_level",
    _BODY + "SELECT doc_id, block_idx, CASE r % 8 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 4 THEN 1 ELSE CASE WHEN r % 32 = 14 THEN 3 "
    "WHEN r % 32 = 6 AND r % 5 <> 0 THEN 2 END END AS heading_level FROM b",
)
def heading_level(spark, sf_dir):
    return W.heading_level(X.body(spark, sf_dir), W.style_levels(X.styles(spark)))


@query("numbering_format", _BODY + f"SELECT doc_id, block_idx, {_FMT} AS num_fmt FROM b")
def numbering_format(spark, sf_dir):
    out = W.numbering_format(X.body(spark, sf_dir), X.numbering(spark), X.numbering_levels(spark))
    return out.select("doc_id", "block_idx", "num_fmt")


def _formatted(spark, sf_dir):
    return W.numbering_format(X.body(spark, sf_dir), X.numbering(spark), X.numbering_levels(spark))


@query(
    "list_type",
    _BODY + f"SELECT doc_id, block_idx, CASE WHEN fmt = 'bullet' THEN 'bullet' WHEN fmt IS NOT NULL THEN 'number' WHEN r % 8 = 2 THEN 'bullet' "
    f"WHEN r % 8 IN (3, 7) THEN 'number' WHEN r % 32 = 22 THEN 'bullet' WHEN r % 32 = 30 THEN 'number' END AS list_type FROM (SELECT *, {_FMT} AS fmt FROM b)",
)
def list_type(spark, sf_dir):
    return W.list_type(_formatted(spark, sf_dir), X.styles(spark))


@query("list_level", _BODY + f"SELECT doc_id, block_idx, {_LEVEL} AS list_level FROM b")
def list_level(spark, sf_dir):
    return W.list_level(X.body(spark, sf_dir), X.styles(spark))


@query(
    "hierarchical_numbers",
    f"""WITH b AS ({_R}), brk AS (SELECT doc_id, block_idx AS brk_idx FROM b WHERE r % 64 = 63),
    i AS (SELECT b.doc_id, b.block_idx, {_LEVEL} AS lv, {_FMT} AS fmt,
            CASE WHEN r % 8 IN (3, 7) AND r % 3 < 2 THEN 'num:' || CASE WHEN r % 5 < 3 THEN '1' ELSE '2' END
                 ELSE CASE r % 8 WHEN 3 THEN 'ListNumber2' WHEN 7 THEN 'ListParagraph' ELSE 'generic' END END AS k,
            (SELECT count(*) FROM brk WHERE brk.doc_id = b.doc_id AND brk_idx < b.block_idx) AS g
          FROM b WHERE (r % 8 IN (3, 7) OR r % 32 = 30) AND r % 64 <> 63 AND coalesce({_FMT}, '') <> 'bullet'),
    lv AS (SELECT unnest(range(0, 11)) AS n),
    c AS (SELECT a.doc_id, a.block_idx, n,
      (SELECT count(*) FROM i x WHERE x.doc_id = a.doc_id AND x.g = a.g AND x.k = a.k AND x.lv = n AND x.block_idx <= a.block_idx
         AND x.block_idx > coalesce((SELECT max(y.block_idx) FROM i y WHERE y.doc_id = a.doc_id AND y.g = a.g AND y.k = a.k AND y.lv < n AND y.block_idx <= a.block_idx), -1)) AS v,
      coalesce((SELECT arg_max(x.fmt, x.block_idx) FROM i x WHERE x.doc_id = a.doc_id AND x.g = a.g AND x.k = a.k AND x.lv = n AND x.block_idx <= a.block_idx AND x.fmt IS NOT NULL), 'decimal') AS f
      FROM i a, lv WHERE n <= a.lv)
    SELECT doc_id, block_idx, string_agg(CASE
      WHEN f = 'lowerLetter' THEN CASE WHEN v <= 26 THEN chr(CAST(96 + v AS INT)) ELSE chr(CAST(96 + (v - 1) // 26 AS INT)) || chr(CAST(97 + (v - 1) % 26 AS INT)) END
      WHEN f IN ('lowerRoman', 'upperRoman') THEN CASE WHEN f = 'lowerRoman' THEN lower(ro) ELSE ro END
      ELSE CAST(v AS VARCHAR) END, '.' ORDER BY n) AS number
    FROM (SELECT *, ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][v // 10 % 10 + 1]
                    || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][v % 10 + 1] AS ro FROM c) WHERE v > 0 GROUP BY 1, 2""",
)
def hierarchical_numbers(spark, sf_dir):
    styles = X.styles(spark)
    rows = W.with_list_level(W.with_list_type(_formatted(spark, sf_dir), styles), styles)
    is_break = F.regexp_extract("text", r"(\d+)\D*$", 1).cast("bigint") % 64 == 63
    items = rows.withColumn("is_break", is_break).filter(F.col("is_break") | (F.col("list_type") == "number"))
    list_key = W.list_key(F.col("num_id"), F.col("style_id"), F.lit(None).cast("string"), F.col("list_level"))
    return W.hierarchical_numbers(
        items.select("doc_id", "block_idx", list_key.alias("list_key"), F.col("list_level").alias("level"), "num_fmt", "is_break")
    )


@query(
    "number_labels",
    """SELECT DISTINCT q, CASE WHEN q <= 26 THEN chr(CAST(64 + q AS INT)) ELSE chr(CAST(64 + (q - 1) // 26 AS INT)) || chr(CAST(65 + (q - 1) % 26 AS INT)) END AS letters,
      lower(['', 'X', 'XX', 'XXX', 'XL', 'L'][q // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][q % 10 + 1]) AS roman, CAST(q AS VARCHAR) AS plain
      FROM (SELECT CAST(l_quantity AS BIGINT) AS q FROM lineitem)""",
)
def number_labels(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("bigint").alias("q")).distinct()
    return q.select(
        "q", OF.number_label(F.col("q"), F.lit("upperLetter")).alias("letters"),
        OF.number_label(F.col("q"), F.lit("lowerRoman")).alias("roman"),
        OF.number_label(F.col("q"), F.lit("decimal")).alias("plain"),
    )


def _marks(spark, sf_dir):
    blocks = X.blocks(spark, sf_dir)
    signals = W.table_signals(blocks, X.cells(spark, sf_dir))
    return blocks, signals, W.boilerplate_marks(blocks, signals, X.styles(spark))


@query("document_profile", _DOCS + "SELECT d AS doc_id, CASE WHEN d % 4 = 2 THEN 'GENERIC' ELSE 'GENERATED' END AS profile FROM docs")
def document_profile(spark, sf_dir):
    blocks, signals, _ = _marks(spark, sf_dir)
    return W.document_profile(blocks, signals, X.props(spark, sf_dir), X.GENERATOR)


@query(
    "drop_boilerplate",
    _DOCS + f""", extra AS (SELECT d, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, {', '.join(str(X.TAIL + i) for i in range(7))}]) AS p FROM docs),
    kept AS (SELECT d, p FROM extra WHERE p >= {X.TAIL} OR p < 5 AND d % 4 < 2 OR p = 5 AND d % 4 = 0 OR p > 5 AND d % 4 <> 1)
    SELECT d AS doc_id, p AS block_idx FROM kept WHERE d % 4 = 2
    UNION ALL SELECT o_orderkey // {D}, o_orderkey % {D} + {X.BODY} FROM orders""",
)
def drop_boilerplate(spark, sf_dir):
    blocks, signals, marks = _marks(spark, sf_dir)
    profiles = W.document_profile(blocks, signals, X.props(spark, sf_dir), X.GENERATOR)
    return W.drop_boilerplate(blocks, marks, profiles).filter("NOT is_skipped").select("doc_id", "block_idx")


@query(
    "endnote_rows",
    _DOCS + "SELECT d AS doc_id, 1 AS num, 'first of ' || d AS text FROM docs UNION ALL SELECT d, 2, 'third of ' || d FROM docs",
)
def endnote_rows(spark, sf_dir):
    blocks = X.blocks(spark, sf_dir)
    marks = W.document_marks(blocks, W.table_signals(blocks, X.cells(spark, sf_dir)))
    return W.endnote_rows(blocks, X.runs(spark, sf_dir), marks)


@query(
    "property_metadata",
    f"""WITH p AS (SELECT o_orderkey // {D} AS doc_id, o_orderkey AS r FROM orders)
    SELECT doc_id, key, 'v' || CASE WHEN key LIKE 'custom%' THEN min(r) ELSE max(r) END AS value FROM (
      SELECT *, CASE r % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'company' WHEN 2 THEN 'date' WHEN 3 THEN 'custom_key_' || (r // 6 % 3)
        WHEN 4 THEN 'company' ELSE 'recipient' END AS key FROM p) GROUP BY 1, 2
    UNION ALL SELECT DISTINCT doc_id, 'generator', ' Report Writer ' FROM p WHERE doc_id % 4 = 3""",
)
def property_metadata(spark, sf_dir):
    return W.property_metadata(X.props(spark, sf_dir))


@query(
    "cover_metadata",
    _DOCS + "SELECT d AS doc_id, 'INVESTMENT MEMO' AS report_type, 'TCK' || d AS identity, 'Annual review of document number ' || d AS title, "
    "'For the year of ' || d AS subtitle, 'Company ' || d AS company, 'SECTOR ' || d AS sector, 'TCK' || d AS ticker FROM docs WHERE d % 4 < 2",
)
def cover_metadata(spark, sf_dir):
    blocks, cells = X.blocks(spark, sf_dir), X.cells(spark, sf_dir)
    return W.cover_metadata(blocks, cells, W.document_marks(blocks, W.table_signals(blocks, cells)))


@query(
    "callout_from_table",
    _BODY + "SELECT doc_id, block_idx, CASE r % 6 WHEN 0 THEN '요약' WHEN 1 THEN '시사점' WHEN 2 THEN '주의' ELSE '참고' END AS title, "
    "CASE r % 6 WHEN 0 THEN 's ' WHEN 1 THEN 'no prefix ' WHEN 2 THEN 'x ' WHEN 3 THEN 'y ' ELSE 'z ' END || r AS text FROM b WHERE r % 6 < 5",
)
def callout_from_table(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey DIV {D} AS doc_id", f"o_orderkey % {D} + {X.BODY} AS block_idx", "'t' AS kind", "1 AS n_rows", "1 AS n_cols",
        "CASE o_orderkey % 6 WHEN 0 THEN '003366' WHEN 1 THEN 'e6f0fa' END AS fill",
        "CASE o_orderkey % 6 WHEN 0 THEN 'Executive Summary: s ' WHEN 1 THEN ' no prefix ' WHEN 2 THEN 'WARNING: x ' WHEN 3 THEN '[NOTE] y ' "
        "WHEN 4 THEN '참고: z ' ELSE 'plain ' END || o_orderkey AS text",
    )
    return W.callout_from_table(rows)


@query(
    "column_alignment_vote",
    "SELECT l_orderkey AS doc_id, 0 AS block_idx, l_linenumber AS col_idx, CASE WHEN bool_or(l_returnflag = 'R') THEN 'right' "
    "WHEN bool_or(l_returnflag = 'A') THEN 'center' ELSE 'left' END AS alignment FROM lineitem GROUP BY 1, 2, 3",
)
def column_alignment_vote(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "0 AS block_idx", "l_linenumber AS col_idx", "CASE l_returnflag WHEN 'R' THEN 'right' WHEN 'A' THEN 'center' END AS align"
    )
    return W.column_alignment_vote(cells)


_CH = (
    "printf('%02X', CAST(round_even((CASE WHEN r % 3 = 0 THEN round_even({c} + (255 - {c}) * (153 / 255.0::DOUBLE), 0) ELSE {c}::DOUBLE END) "
    "* (CASE WHEN r % 2 = 0 THEN 191 / 255.0::DOUBLE ELSE 1.0::DOUBLE END), 0) AS INT))"
)


@query(
    "theme_color",
    f"""WITH b AS ({_R}), c AS (SELECT *, CASE r % 4 WHEN 0 THEN 68 WHEN 3 THEN NULL ELSE 17 END AS c1, CASE r % 4 WHEN 0 THEN 114 ELSE doc_id % 256 END AS c2,
      CASE r % 4 WHEN 0 THEN 196 ELSE 51 END AS c3 FROM b)
    SELECT doc_id, block_idx, CASE WHEN r % 4 <> 3 THEN '#' || {_CH.format(c='c1')} || {_CH.format(c='c2')} || {_CH.format(c='c3')} END AS color_hex FROM c""",
)
def theme_color(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey DIV {D} AS doc_id", f"o_orderkey % {D} + {X.BODY} AS block_idx",
        "CASE o_orderkey % 4 WHEN 0 THEN 'Accent_1' WHEN 1 THEN 'dk-1' WHEN 2 THEN 'text1' ELSE 'none' END AS theme_color",
        "CASE WHEN o_orderkey % 3 = 0 THEN '99' ELSE '' END AS tint", "CASE WHEN o_orderkey % 2 = 0 THEN 'BF' ELSE '' END AS shade",
    )
    theme = table(spark, sf_dir, "orders").selectExpr(f"o_orderkey DIV {D} AS doc_id").distinct().selectExpr(
        "doc_id", "explode(array(struct('accent1' AS name, '#4472C4' AS hex), struct('dk1' AS name, '#11' || lpad(hex(doc_id % 256), 2, '0') || '33' AS hex))) AS t"
    ).select("doc_id", "t.name", "t.hex")
    return W.theme_color(runs, theme, ["doc_id"]).select("doc_id", "block_idx", "color_hex")


@query(
    "image_refs",
    f"""WITH i AS (SELECT o_orderkey // {D} AS doc_id, o_orderkey // 4 AS block_idx, o_orderkey AS r, 'rId' || (o_orderkey % 3) AS rel_id FROM orders),
    f AS (SELECT doc_id, block_idx, rel_id, min(r) AS r FROM i GROUP BY 1, 2, 3)
    SELECT doc_id, block_idx, r AS ord, rel_id, CASE r % 5 WHEN 0 THEN 'Chart ' || r WHEN 1 THEN 'Title ' || r WHEN 2 THEN 'Name ' || r
        ELSE CASE WHEN r % 3 = 2 THEN 'Image' ELSE 'Asset ' || (r % 3) END END AS alt_text,
      CASE WHEN r % 3 = 2 THEN '' ELSE 'image_' || (r % 3) || '.png' END AS path, CASE WHEN r % 3 < 2 THEN 'image/png' END AS mime FROM f""",
)
def image_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey DIV {D} AS doc_id", "o_orderkey DIV 4 AS block_idx", "o_orderkey AS ord", "'rId' || (o_orderkey % 3) AS rel_id",
        "CASE o_orderkey % 5 WHEN 0 THEN 'Chart ' || o_orderkey WHEN 1 THEN 'photo.PNG' END AS descr",
        "CASE o_orderkey % 5 WHEN 1 THEN ' Title ' || o_orderkey END AS title",
        "CASE o_orderkey % 5 WHEN 2 THEN 'Name ' || o_orderkey WHEN 3 THEN 'Picture 7' WHEN 4 THEN 'fig1.jpeg' END AS name",
    )
    assets = table(spark, sf_dir, "orders").selectExpr(f"o_orderkey DIV {D} AS doc_id").distinct().selectExpr(
        "doc_id", "explode(array(0, 1)) AS n"
    ).selectExpr("doc_id", "'rId' || n AS rel_id", "'image_' || n || '.png' AS path", "'image/png' AS mime", "'Asset ' || n AS default_alt_text")
    return W.image_refs(refs, assets)


@query(
    "split_mixed_paragraphs",
    f"""WITH t AS (SELECT o_orderkey // {D} AS doc_id, o_orderkey // 8 AS block_idx, o_orderkey AS r, o_orderkey % 8 AS i FROM orders),
    p AS (SELECT doc_id, block_idx, CASE WHEN i < 2 THEN 0 WHEN i = 2 THEN 1 WHEN i < 5 THEN 2 WHEN i = 5 THEN 3 ELSE 4 END AS part,
      CASE WHEN i IN (2, 5) THEN 'image' ELSE 'text' END AS kind, trim(string_agg(CASE WHEN i IN (2, 5) THEN '' ELSE ' t' || r || ' ' END, '' ORDER BY i)) AS text
      FROM t GROUP BY 1, 2, 3, 4)
    SELECT doc_id, block_idx, row_number() OVER (PARTITION BY doc_id, block_idx ORDER BY part) - 1 AS part, kind, text FROM p""",
)
def split_mixed_paragraphs(spark, sf_dir):
    tokens = table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey DIV {D} AS doc_id", "o_orderkey DIV 8 AS block_idx", "o_orderkey % 8 AS tok_idx",
        "CASE WHEN o_orderkey % 8 IN (2, 5) THEN 'image' WHEN o_orderkey % 8 = 4 THEN 'note' ELSE 'text' END AS kind",
        "CASE WHEN o_orderkey % 8 IN (2, 5) THEN NULL ELSE ' t' || o_orderkey || ' ' END AS text",
    )
    return W.split_mixed_paragraphs(tokens)


@query(
    "semantic_bookmarks",
    _BODY + "SELECT doc_id, block_idx, CASE r % 6 WHEN 0 THEN 'SEPARATOR' WHEN 2 THEN 'DIAGRAM' ELSE 'CODE_BLOCK' END AS type, "
    "CASE r % 6 WHEN 1 THEN 'sql' WHEN 3 THEN 'py' ELSE '' END AS extra FROM b WHERE r % 6 < 4",
)
def semantic_bookmarks(spark, sf_dir):
    return W.semantic_bookmarks(X.body(spark, sf_dir))


@query(
    "native_notes",
    f"""WITH n AS (SELECT o_orderkey // {D} AS doc_id, o_orderkey // 4 AS num, o_orderkey AS r FROM orders)
    SELECT doc_id, CAST(num AS INT) AS num, string_agg('p' || r, ' ' ORDER BY r) AS text FROM n
    WHERE r % 4 <> 2 AND num % 7 <> 0 AND num % 5 <> 0 GROUP BY 1, 2""",
)
def native_notes(spark, sf_dir):
    notes = table(spark, sf_dir, "orders").selectExpr(
        f"o_orderkey DIV {D} AS doc_id", "CASE WHEN o_orderkey DIV 4 % 5 = 0 THEN '-1' ELSE CAST(o_orderkey DIV 4 AS STRING) END AS id",
        "CASE WHEN o_orderkey DIV 4 % 7 = 0 THEN 'separator' END AS type", "o_orderkey AS ord",
        "CASE WHEN o_orderkey % 4 = 2 THEN '  ' ELSE ' p' || o_orderkey || ' ' END AS piece",
    )
    return W.native_notes(notes)


# --- flow: ranges, typed blocks, Markdown --------------------------------------------------

_SPANS = f"""spans AS (
  SELECT doc_id, block_idx AS s, CASE WHEN r % 64 = 63 THEN block_idx + 1 END AS e FROM b WHERE r % 64 = 63
  UNION ALL SELECT doc_id, block_idx, block_idx + 20 FROM b WHERE r % 128 IN (100, 105)
  UNION ALL SELECT doc_id, block_idx, NULL FROM b WHERE r % 512 = 401 AND doc_id % 8 = 3
  UNION ALL SELECT doc_id, -5, NULL FROM b WHERE r % 512 = 50 AND doc_id % 16 = 5),
held AS (SELECT DISTINCT b.r FROM b JOIN spans USING (doc_id) WHERE block_idx >= s AND (e IS NULL OR block_idx < e))"""


#: The body's texts, types and numbers from the base table.
_TYPED = f"""texts AS (
  SELECT o_orderkey AS r, CASE WHEN o_orderkey % 32 = 22 THEN '• item ' || o_orderkey WHEN o_orderkey % 32 = 30 THEN '3) item ' || o_orderkey
    WHEN o_orderkey % 32 = 6 AND o_orderkey % 5 = 0 THEN 'Full stop ' || o_orderkey || '.' ELSE o_orderpriority || ' ' || o_orderkey END AS text FROM orders),
facts AS (
  SELECT b.*, t.text, CASE r % 8 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 4 THEN 1 ELSE CASE WHEN r % 32 = 14 THEN 3 WHEN r % 32 = 6 AND r % 5 <> 0 THEN 2 END END AS h,
    {_FMT} AS fmt, {_LEVEL} AS lv, regexp_matches(t.text, '^[0-9]+[.)]\\s+.') AS vis,
    CASE WHEN r % 8 IN (3, 7) AND r % 3 < 2 THEN 'num:' || CASE WHEN r % 5 < 3 THEN '1' ELSE '2' END
      ELSE CASE r % 8 WHEN 3 THEN 'ListNumber2' WHEN 7 THEN 'ListParagraph' ELSE 'generic' END END AS k
  FROM b JOIN texts t USING (r)),
typed AS (
  SELECT *, CASE WHEN r % 6 = 0 THEN 'separator' WHEN r % 6 IN (1, 3) THEN 'code' WHEN r % 6 = 2 THEN 'diagram' WHEN h > 0 THEN 'heading'
    WHEN fmt = 'bullet' THEN 'bullet' WHEN fmt IS NOT NULL THEN 'number' WHEN r % 8 = 2 THEN 'bullet' WHEN r % 8 IN (3, 7) THEN 'number'
    WHEN r % 32 = 22 THEN 'bullet' WHEN vis THEN 'number' ELSE 'paragraph' END AS type FROM facts)"""


def _numbers(skipped: str) -> str:
    """CTEs ending in ``numbers(r, number)`` of the items without a visible number; ``skipped`` has the ``r`` of breaks."""
    return f"""brk AS (SELECT doc_id, block_idx AS brk_idx FROM b SEMI JOIN {skipped} USING (r)),
i AS (
  SELECT t.*, (SELECT count(*) FROM brk WHERE brk.doc_id = t.doc_id AND brk_idx < t.block_idx) AS g
  FROM typed t ANTI JOIN {skipped} USING (r) WHERE type = 'number' AND NOT vis),
lvs AS (SELECT unnest(range(0, 11)) AS n),
c AS (SELECT a.r, n,
  (SELECT count(*) FROM i x WHERE x.doc_id = a.doc_id AND x.g = a.g AND x.k = a.k AND x.lv = n AND x.block_idx <= a.block_idx
     AND x.block_idx > coalesce((SELECT max(y.block_idx) FROM i y WHERE y.doc_id = a.doc_id AND y.g = a.g AND y.k = a.k AND y.lv < n AND y.block_idx <= a.block_idx), -1)) AS v,
  coalesce((SELECT arg_max(x.fmt, x.block_idx) FROM i x WHERE x.doc_id = a.doc_id AND x.g = a.g AND x.k = a.k AND x.lv = n AND x.block_idx <= a.block_idx AND x.fmt IS NOT NULL), 'decimal') AS f
  FROM i a, lvs WHERE n <= a.lv),
numbers AS (SELECT r, string_agg(CASE
    WHEN f = 'lowerLetter' THEN CASE WHEN v <= 26 THEN chr(CAST(96 + v AS INT)) ELSE chr(CAST(96 + (v - 1) // 26 AS INT)) || chr(CAST(97 + (v - 1) % 26 AS INT)) END
    WHEN f = 'lowerRoman' THEN lower(ro) WHEN f = 'upperRoman' THEN ro ELSE CAST(v AS VARCHAR) END, '.' ORDER BY n) AS number
  FROM (SELECT *, ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][v // 10 % 10 + 1]
                  || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][v % 10 + 1] AS ro FROM c) WHERE v > 0 GROUP BY 1)"""


_TYPED_ROWS = """SELECT r, doc_id, block_idx AS source_idx, type,
    CASE type WHEN 'heading' THEN h WHEN 'bullet' THEN lv WHEN 'number' THEN lv END AS level,
    CASE WHEN type = 'number' THEN CASE WHEN vis THEN regexp_extract(text, '^([0-9]+)', 1) ELSE number END END AS number,
    CASE type WHEN 'code' THEN CASE r % 6 WHEN 1 THEN 'sql' ELSE 'py' END WHEN 'diagram' THEN '' END AS language,
    CASE WHEN type = 'bullet' AND text LIKE '• %' THEN text[3:] WHEN type = 'number' AND vis THEN regexp_replace(text, '^[0-9]+[.)]\\s+', '') ELSE text END AS text
  FROM typed LEFT JOIN numbers USING (r)"""


@query("drop_spans", f"{_BODY.rstrip()}, {_SPANS}, {_TYPED} SELECT doc_id, block_idx, text FROM typed ANTI JOIN held USING (r)")
def drop_spans(spark, sf_dir):
    return OW.drop_spans(X.body(spark, sf_dir), X.spans(spark, sf_dir)).select("doc_id", "block_idx", "text")


def _typed(blocks, spark, spans):
    return OW.office_to_blocks(blocks, X.styles(spark), X.numbering(spark), X.numbering_levels(spark), spans)


@query(
    "office_to_blocks",
    f"""{_BODY.rstrip()}, {_SPANS}, {_TYPED}, {_numbers("held")}, kept AS ({_TYPED_ROWS} ANTI JOIN held USING (r))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY source_idx) - 1 AS block_idx, source_idx, type, CAST(level AS INT) AS level, number,
      CAST(NULL AS VARCHAR) AS title, language, text FROM kept""",
)
def office_to_blocks(spark, sf_dir):
    return _typed(X.body(spark, sf_dir), spark, X.spans(spark, sf_dir))


def _boilerplate(spark, sf_dir):
    blocks, signals, marks = _marks(spark, sf_dir)
    profiles = W.document_profile(blocks, signals, X.props(spark, sf_dir), X.GENERATOR)
    return blocks, marks.join(profiles.filter("profile = 'GENERATED'"), "doc_id", "left_semi"), OW.boilerplate_spans(marks, profiles)


_NONE = "none AS (SELECT r FROM b WHERE false)"


@query(
    "office_to_markdown",
    f"""{_BODY.rstrip()}, {_NONE}, {_TYPED}, {_numbers("none")}, kept AS ({_TYPED_ROWS}),
    body AS (SELECT doc_id, source_idx AS p, CASE type WHEN 'heading' THEN repeat('#', level) || ' ' || text
      WHEN 'bullet' THEN repeat('  ', level) || '- ' || text WHEN 'number' THEN repeat('  ', level) || number || '. ' || text
      WHEN 'separator' THEN '---' WHEN 'code' THEN '```' || language || chr(10) || text || chr(10) || '```'
      WHEN 'diagram' THEN '```diagram' || chr(10) || text || chr(10) || '```' ELSE text END AS md FROM kept),
    docs AS (SELECT DISTINCT doc_id AS d FROM b),
    extra AS (SELECT d, unnest([(6, '{K.TOC_TITLE}'), (7, 'field'), (8, 'x' || d), (9, 'Press {K.TOC_NOTE} now'), ({X.TAIL}, '{K.ENDNOTES_TITLE}'),
      ({X.TAIL + 1}, '1 first of ' || d), ({X.TAIL + 2}, '2 second of ' || d), ({X.TAIL + 3}, 'no note'), ({X.TAIL + 4}, '2 third of ' || d),
      ({X.TAIL + 5}, '{K.DISCLAIMER_TITLE}'), ({X.TAIL + 6}, 'closing words')]) AS x FROM docs WHERE d % 4 = 2),
    parts AS (SELECT doc_id, p, md FROM body UNION ALL SELECT d, x[1], x[2] FROM extra)
    SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY p) || chr(10)
      || CASE WHEN doc_id % 4 <> 2 THEN chr(10) || '## Citations' || chr(10) || '1. first of ' || doc_id || chr(10) || '2. third of ' || doc_id || chr(10) ELSE '' END AS markdown
    FROM parts GROUP BY doc_id""",
)
def office_to_markdown(spark, sf_dir):
    blocks, marks, spans = _boilerplate(spark, sf_dir)
    notes = W.endnote_rows(blocks, X.runs(spark, sf_dir), marks)  # of generated documents
    return OW.office_to_markdown(_typed(blocks, spark, spans), X.cells(spark, sf_dir), notes)
