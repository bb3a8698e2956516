"""SQL over the base tables that states what every corpus query must return.

Nothing here parses text: report relations are computed straight from the
tables the reports were assembled from.
"""

from __future__ import annotations

from .corpora import BOX_LINE, BOX_SHORT, PRIORITIES

_PRIO = ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS p{i}" for i, p in enumerate(PRIORITIES))

DOC = f"""doc AS (
  SELECT r.k AS doc_id, r.*, c_name, c_mktsegment AS seg,
         CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS acct
  FROM (SELECT o_custkey AS k, count(*) AS n,
               strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, {_PRIO}
        FROM orders GROUP BY 1) r
  JOIN customer ON c_custkey = r.k)"""

_NL = "chr(10)"
_BALANCE = (
    f"'Balance is ' || acct || {_NL} || 'next (line) of ' || k || {_NL} || "
    "'<span style=\"color:#a1b2c3\">tint ' || k || '</span> and H~2~O ' || chr(92) || '[done' || chr(92) || ']'"
)
_BALANCE_MD = (
    f"'Balance is ' || acct || {_NL} || 'next (line) of ' || k || {_NL} || "
    "'<span style=\"color:#A1B2C3\">tint ' || k || '</span> and H~2~O [done]'"
)
_CODE = (
    f"'# not a heading ' || k || {_NL} || '| a | b |' || CASE k % 6 WHEN 0 THEN {_NL} || '{BOX_LINE}' "
    f"WHEN 3 THEN {_NL} || '{BOX_SHORT}' ELSE '' END"
)

# (order, condition, type, level, text, rendered text; None = same as text)
BLOCKS: list[tuple] = [
    (10, "true", "HEADING_1", 1, "c_name || ' - order report'", "'# ' || c_name || ' - order report'"),
    (11, "k % 3 <> 0", "HEADING_2", 2, "'Segment ' || seg", "'## Segment ' || seg"),
    (20, "k % 3 = 0", "PARAGRAPH", None, "'**작성자:** Analyst ' || (k % 4)", None),
    (21, "k % 3 = 0", "PARAGRAPH", None, "'**As of: ' || last_day || '**'", None),
    (22, "k % 3 = 0", "PARAGRAPH", None, "'**Recipient:** Desk ' || (k % 5)", None),
    (20, "k % 3 <> 0", "PARAGRAPH", None, "'**Report date:** ' || last_day", None),
    (21, "k % 3 <> 0", "PARAGRAPH", None, "'**Sector**: ' || seg", None),
    (22, "k % 3 = 1", "BULLET_LIST", None, "'intro'", "'- intro'"),
    (23, "k % 3 = 1", "PARAGRAPH", None, "'**Recipient:** Desk ' || (k % 5)", None),
    (30, "true", "HEADING_2", 2, "'1. Overview'", "'## 1. Overview'"),
    (40, "true", "PARAGRAPH", None,
     "'Customer **' || k || '** has *' || n || '* orders^1^ and $x_' || k || '$.'",
     "'Customer **' || k || '** has *' || n || '* orders^1^ and x_' || k || '.'"),
    (41, "true", "PARAGRAPH", None, _BALANCE, _BALANCE_MD),
    (50, "true", "HEADING_3", 3, "'Detail'", "'### Detail'"),
    (60, "true", "TABLE", None, "NULL", "NULL"),
    (70, "true", "BLOCKQUOTE", None, "'Balance ' || acct || ' second line'",
     f"'> **[NOTE]**' || {_NL} || '> Balance ' || acct || ' second line'"),
    *[(80 + i, f"p{i} > 0", "BULLET_LIST", None, f"'{p}: ' || p{i}", f"'- {p}: ' || p{i}")
      for i, p in enumerate(PRIORITIES)],
    (86, "true", "BULLET_LIST", None, "'nested ' || k", "'  - nested ' || k"),
    (90, "true", "NUMBERED_LIST", None, "'first item of ' || k || ', kept as a list.'",
     "'1. first item of ' || k || ', kept as a list.'"),
    (95, "true", "NUMBERED_HEADING", 2, "'2. Closing remarks'", "'## 2. Closing remarks'"),
    (100, "true", "SEPARATOR", None, "NULL", "'---'"),
    (110, "true", "CODE_BLOCK", None, _CODE, f"'```sql' || {_NL} || {_CODE} || {_NL} || '```'"),
    (115, "k % 9 = 0", "DIAGRAM", None, "'title: D' || k",
     f"'```diagram:flow' || {_NL} || 'title: D' || k || {_NL} || '```'"),
    (120, "true", "LATEX_BLOCK", None, "'y_' || k || '=1'",
     f"'$$' || {_NL} || 'y_' || k || '=1' || {_NL} || '$$'"),
    (125, "true", "LATEX_BLOCK", None, "'z_' || k", f"'$$' || {_NL} || 'z_' || k || {_NL} || '$$'"),
    (130, "true", "IMAGE", None, "NULL", "'![chart ' || k || '](img/' || k || '.png)'"),
    (140, "k % 2 = 0", "NUMBERED_HEADING", 1, "'**7. Annex ' || k || '**'", "'# 7. Annex ' || k"),
    (150, "true", "PARAGRAPH", None, "'tail note.2 of ' || k", None),
    (160, "k % 4 = 0", "HEADING_4", 4, "'Appendix ' || k", "'#### Appendix ' || k"),
]


def _block_rows() -> str:
    rows = [
        f"SELECT doc_id, k, {o} AS ord, '{t}' AS type, {'NULL' if lv is None else lv} AS level, "
        f"CAST({tx} AS VARCHAR) AS text, CAST({md or tx} AS VARCHAR) AS md FROM doc WHERE {cond}"
        for o, cond, t, lv, tx, md in BLOCKS
    ]
    return "\n UNION ALL ".join(rows)


BLK = f"""blk0 AS ({_block_rows()}),
blk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS block_idx,
               NOT (k % 3 <> 0 AND ord <= 21) AS in_body FROM blk0)"""

TROW = f"""trow AS (
  SELECT doc_id, k, 0 AS row_idx, ['Order', 'Status',
         ['Revenue 2025', 'Impact', 'CMR', 'Amount', 'Upside'][k % 5 + 1], 'Date'] AS cells FROM doc
  UNION ALL
  SELECT o_custkey, o_custkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey),
         [CAST(o_orderkey AS VARCHAR), o_orderstatus,
          CASE o_custkey % 5 WHEN 1 THEN ['High', 'Medium', 'Low'][o_orderkey % 3 + 1]
            WHEN 3 THEN '(' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ')'
            WHEN 4 THEN '-' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
            ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END,
          strftime(o_orderdate, '%Y-%m-%d')]
  FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL
  SELECT doc_id, k, n + 1, [CAST(k AS VARCHAR), 'Z', '1', '2'] FROM doc WHERE k % 11 = 0
  UNION ALL
  SELECT doc_id, k, n + 1 + CAST(k % 11 = 0 AS INT), [CAST(k AS VARCHAR), 'short', '', ''] FROM doc WHERE k % 13 = 0),
tbl AS (SELECT doc_id, block_idx, k,
  ['FINANCIAL', 'RISK_MATRIX', 'BEP_SENSITIVITY', 'GENERIC', 'UPSIDE_DOWNSIDE'][k % 5 + 1] AS table_type,
  4 AS n_cols FROM blk WHERE type = 'TABLE'),
nrow AS (SELECT doc_id, count(*) AS n_rows FROM trow GROUP BY 1),
cell AS (SELECT t.doc_id, b.block_idx, t.k, t.row_idx, j AS col_idx, t.cells[j + 1] AS text, b.table_type, n_rows,
  CASE WHEN t.k % 17 = 0 THEN 'left' ELSE ['left', 'center', 'right', 'left'][j + 1] END AS alignment
  FROM trow t JOIN tbl b USING (doc_id) JOIN nrow USING (doc_id), (SELECT unnest([0, 1, 2, 3]) AS j))"""

FORMATTED = (
    "CASE WHEN table_type = 'FINANCIAL' AND col_idx > 0 AND regexp_matches(text, '^[0-9]') THEN "
    "format('{:,}', CAST(regexp_extract(text, '^[0-9]+') AS BIGINT)) || regexp_replace(text, '^[0-9]+', '') "
    "ELSE text END"
)

META = f"""meta AS (
  SELECT doc_id, k, c_name || ' - order report' AS title,
    CASE WHEN k % 3 = 0 THEN '' ELSE 'Segment ' || seg END AS subtitle,
    CASE WHEN k % 3 = 0 THEN 'Korea Development Bank' ELSE '' END AS company,
    '' AS ticker, CASE WHEN k % 3 = 0 THEN seg ELSE 'SECTOR' END AS sector, seg, last_day,
    CASE WHEN k % 6 = 0 THEN 'E' || (k % 5) ELSE 'D' || (k % 7) END AS desk
  FROM doc)"""


def _unpivot(fields: list[tuple[str, str, str]]) -> str:
    return "\n UNION ALL ".join(
        f"SELECT doc_id, '{key}' AS key, CAST({value} AS VARCHAR) AS value FROM meta WHERE {cond}"
        for key, value, cond in fields
    )


_FIXED = [
    ("title", "title", "true"), ("subtitle", "subtitle", "true"), ("company", "company", "true"),
    ("ticker", "ticker", "true"), ("sector", "sector", "true"),
]
PARSED_META = _unpivot([
    *_FIXED, ("analyst", "'DCM Team 1'", "true"), ("extra.desk", "desk", "k % 3 = 0"),
    ("extra.Report date", "last_day", "k % 3 <> 0"), ("extra.Sector", "seg", "k % 3 <> 0"),
])
INFERRED_META = _unpivot([
    *_FIXED, ("analyst", "CASE WHEN k % 3 = 0 THEN 'Analyst ' || (k % 4) ELSE 'DCM Team 1' END", "true"),
    ("extra.desk", "desk", "k % 3 = 0"), ("extra.date", "last_day", "k % 3 = 0"),
    ("extra.recipient", "'Desk ' || (k % 5)", "k % 3 <> 2"),
    ("extra.Report date", "last_day", "k % 3 <> 0"), ("extra.Sector", "seg", "k % 3 <> 0"),
])

FRONT = """'---' || chr(10) || 'title: "' || title || '"' || chr(10) ||
  CASE WHEN k % 3 = 0 THEN 'sector: "' || seg || '"' || chr(10) || 'analyst: "Analyst ' || (k % 4) || '"' || chr(10)
       || 'desk: "' || desk || '"' || chr(10) || 'date: "' || last_day || '"' || chr(10)
       || 'recipient: "Desk ' || (k % 5) || '"' || chr(10)
  ELSE 'subtitle: "' || subtitle || '"' || chr(10) || 'Report date: "' || last_day || '"' || chr(10)
       || 'Sector: "' || seg || '"' || chr(10)
       || CASE WHEN k % 3 = 1 THEN 'recipient: "Desk ' || (k % 5) || '"' || chr(10) ELSE '' END END
  || '---'"""

TABLE_MD = """tmd AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY o) AS md FROM (
    SELECT doc_id, row_idx * 2 AS o, '| ' || array_to_string(cells, ' | ') || ' |' AS line FROM trow
    UNION ALL
    SELECT doc_id, 1, CASE WHEN k % 17 = 0 THEN '| --- | --- | --- | --- |'
                           ELSE '| --- | :---: | ---: | --- |' END FROM doc) GROUP BY 1),
md AS (SELECT b.doc_id, b.k, b.block_idx, b.in_body, b.ord, b.type, coalesce(t.md, b.md) AS markdown
       FROM blk b LEFT JOIN tmd t ON b.doc_id = t.doc_id AND b.type = 'TABLE')"""

NOTES = """notes AS (
  SELECT doc_id, 1 AS num, 'orders of ' || k AS text FROM doc
  UNION ALL
  SELECT doc_id, 2, CASE WHEN k % 2 = 1 THEN 'last note ' || k ELSE 'unused note' END FROM doc)"""

# runs of every paragraph and list item: (type filter, position, text, flags)
RUNS = """runs AS (
  SELECT doc_id, block_idx, r.i AS run_idx, CAST(r.t AS VARCHAR) AS text, r.b AS bold, r.it AS italic, r.sup AS superscript,
         r.sub AS subscript, r.m AS is_latex, r.c AS color_hex
  FROM (
    SELECT b.doc_id, b.block_idx, unnest(CASE
      WHEN ord = 40 THEN [
        {'i': 0, 't': 'Customer ', 'b': false, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL},
        {'i': 1, 't': CAST(d.k AS VARCHAR), 'b': true, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL},
        {'i': 2, 't': ' has ', 'b': false, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL},
        {'i': 3, 't': CAST(n AS VARCHAR), 'b': false, 'it': true, 'sup': false, 'sub': false, 'm': false, 'c': NULL},
        {'i': 4, 't': ' orders', 'b': false, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL},
        {'i': 5, 't': '1', 'b': false, 'it': false, 'sup': true, 'sub': false, 'm': false, 'c': NULL},
        {'i': 6, 't': ' and ', 'b': false, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL},
        {'i': 7, 't': 'x_' || d.k, 'b': false, 'it': false, 'sup': false, 'sub': false, 'm': true, 'c': NULL},
        {'i': 8, 't': '.', 'b': false, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL}]
      WHEN ord = 41 THEN [
        {'i': 0, 't': 'Balance is ' || acct || chr(10) || 'next (line) of ' || d.k || chr(10),
         'b': false, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL},
        {'i': 1, 't': 'tint ' || d.k, 'b': false, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': '#A1B2C3'},
        {'i': 2, 't': ' and H', 'b': false, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL},
        {'i': 3, 't': '2', 'b': false, 'it': false, 'sup': false, 'sub': true, 'm': false, 'c': NULL},
        {'i': 4, 't': 'O [done]', 'b': false, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL}]
      WHEN ord IN (20, 22, 23) AND b.type = 'PARAGRAPH' AND NOT (ord = 20 AND d.k % 3 <> 0) OR ord = 20 AND d.k % 3 <> 0 THEN [
        {'i': 0, 't': CASE WHEN ord <> 20 THEN 'Recipient:' WHEN d.k % 3 = 0 THEN '작성자:' ELSE 'Report date:' END,
         'b': true, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL},
        {'i': 1, 't': CASE WHEN ord <> 20 THEN ' Desk ' || (d.k % 5) WHEN d.k % 3 = 0 THEN ' Analyst ' || (d.k % 4) ELSE ' ' || last_day END,
         'b': false, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL}]
      WHEN ord = 21 AND d.k % 3 = 0 THEN [
        {'i': 0, 't': 'As of: ' || last_day, 'b': true, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL}]
      WHEN ord = 21 THEN [
        {'i': 0, 't': 'Sector', 'b': true, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL},
        {'i': 1, 't': ': ' || seg, 'b': false, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL}]
      ELSE [
        {'i': 0, 't': text, 'b': false, 'it': false, 'sup': false, 'sub': false, 'm': false, 'c': NULL}]
      END) AS r
    FROM blk b JOIN doc d USING (doc_id)
    WHERE b.type IN ('PARAGRAPH', 'BULLET_LIST', 'NUMBERED_LIST')))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = with_(DOC, BLK)
TABLES = with_(DOC, BLK, TROW)


def typed(where: str, columns: str) -> str:
    return BASE + f"SELECT {columns} FROM blk WHERE {where}"
