"""Queries over marked, flat and real texts, and over sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formatter as FM
from ..operators import cleaner as CL
from ..operators import formatter as G
from ..options import CleanerOptions
from ..sources import readers as RD
from ..sources import routing as RT
from ..sources import writers as WR
from . import corpora as C
from .registry import query

# --- research markers -----------------------------------------------------------

_EV = f"""WITH ev AS (
  SELECT user_id * {C.KEY_STEP} + year(ts) * 12 + month(ts) AS doc_id, user_id, event_id, event_type, props,
    event_id % 5 AS m, 'e' || (event_id % 9) AS id1, 'e' || (event_id % 7) AS id2,
    row_number() OVER (PARTITION BY user_id, year(ts), month(ts) ORDER BY event_id) - 1 AS pos,
    user_id % 10 <> 0 AS has FROM events),
src AS (
  SELECT doc_id, source_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_seen) AS num FROM (
    SELECT doc_id, source_id, min(seen) AS first_seen FROM (
      SELECT doc_id, id1 AS source_id, event_id * 2 AS seen FROM ev WHERE has AND m IN (0, 1)
      UNION ALL SELECT doc_id, id2, event_id * 2 + 1 FROM ev WHERE has AND m = 1) GROUP BY 1, 2)),
rep AS (
  SELECT ev.*, CASE WHEN NOT has THEN ''
    WHEN m = 0 THEN '[^' || a.num || ']' WHEN m = 1 THEN '[^' || a.num || '][^' || b.num || ']'
    WHEN m = 2 THEN event_type WHEN m = 3 THEN '<!-- widget: ' || props || ' ' || event_type || ' -->'
    ELSE chr(10) || '<!-- image_group: ' || event_type || ', q' || (event_id % 3) || ' -->' || chr(10) END AS shown
  FROM ev LEFT JOIN src a ON a.doc_id = ev.doc_id AND a.source_id = id1
  LEFT JOIN src b ON b.doc_id = ev.doc_id AND b.source_id = id2),
body AS (
  SELECT doc_id, any_value(user_id) AS user_id, string_agg(event_type || shown, '' ORDER BY event_id) AS body FROM rep GROUP BY 1),
cites AS (
  SELECT doc_id, '## Citations' || chr(10) || string_agg('[^' || num || ']: ' || source_id, chr(10) ORDER BY num) || chr(10) AS cites
  FROM src GROUP BY 1),
orig AS (
  SELECT doc_id, any_value(user_id) AS user_id, sum(length(event_type) + CASE WHEN NOT has THEN 0
    WHEN m = 0 THEN 7 + length(id1) WHEN m = 1 THEN 9 + length(id1) + length(id2)
    WHEN m = 2 THEN 21 + length(event_type) WHEN m = 3 THEN 11 + length(props) + length(event_type)
    ELSE 35 + length(event_type) END) + CASE WHEN any_value(user_id) % 6 = 0 THEN 1 ELSE 0 END AS size FROM ev GROUP BY 1)
"""
_STRAY = "CASE WHEN user_id % 6 = 0 THEN chr(57866) ELSE '' END"
_CLEAN = (
    f"SELECT b.doc_id, CASE WHEN user_id % 10 = 0 THEN body || {_STRAY} WHEN cites IS NULL THEN body "
    "ELSE CASE WHEN user_id % 6 = 0 THEN body ELSE rtrim(body, ' ' || chr(10)) END || chr(10) || chr(10) || cites END AS text "
    "FROM body b LEFT JOIN cites c ON b.doc_id = c.doc_id"
)


@query("detect_markers", _EV + "SELECT DISTINCT doc_id, has AS has_markers FROM ev")
def detect_markers(spark, sf_dir):
    return CL.detect_markers(C.marked(spark, sf_dir))


@query(
    "marker_rows",
    _EV + """SELECT doc_id, pos, CASE WHEN m < 2 THEN 'cite' WHEN m = 2 THEN 'entity' WHEN m = 3 THEN 'widget' ELSE 'image_group' END AS tag,
      CASE m WHEN 0 THEN id1 WHEN 1 THEN id1 || chr(57858) || ' ' || id2 WHEN 2 THEN '["t","' || event_type || '","x"]'
        WHEN 3 THEN props || '  ' || event_type ELSE '{"query": ["' || event_type || '", "q' || (event_id % 3) || '"]}' END AS payload
      FROM ev WHERE has""",
)
def marker_rows(spark, sf_dir):
    return CL.marker_rows(C.marked(spark, sf_dir))


@query("cite_numbers", _EV + "SELECT doc_id, source_id, num FROM src")
def cite_numbers(spark, sf_dir):
    return CL.cite_numbers(C.marked(spark, sf_dir))


def _cite_mode(mode: str, shown: str) -> None:
    sql = _EV + (
        f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY event_id) - 1 AS pos, {shown} AS replacement FROM rep WHERE has AND m < 2"
    )

    @query(f"cite_mode_{mode}", sql)
    def run(spark, sf_dir):
        return CL.cite_texts(C.marked(spark, sf_dir), CleanerOptions("on", mode))


_cite_mode("footnote", "shown")
_cite_mode("inline", "' (sources: ' || id1 || CASE WHEN m = 1 THEN ', ' || id2 ELSE '' END || ')'")
_cite_mode("strip", "''")


@query("entity_text", _EV + "SELECT doc_id, pos, event_type AS replacement FROM ev WHERE has AND m = 2")
def entity_text(spark, sf_dir):
    return CL.entity_texts(C.marked(spark, sf_dir))


@query("image_group_text", _EV + "SELECT doc_id, pos, shown AS replacement FROM rep WHERE has AND m = 4")
def image_group_text(spark, sf_dir):
    return CL.image_group_texts(C.marked(spark, sf_dir))


@query("unknown_marker_text", _EV + "SELECT doc_id, pos, shown AS replacement FROM rep WHERE has AND m = 3")
def unknown_marker_text(spark, sf_dir):
    return CL.unknown_marker_texts(C.marked(spark, sf_dir))


@query("clean_text", _EV + _CLEAN)
def clean_text(spark, sf_dir):
    return CL.clean_corpus(C.marked(spark, sf_dir), CleanerOptions("auto"))


@query(
    "append_citations",
    _EV + "SELECT c.doc_id, cites FROM cites c",
)
def append_citations(spark, sf_dir):
    texts = CL.clean_corpus(C.marked(spark, sf_dir), CleanerOptions("on"))
    cites = F.regexp_extract("text", r"(?s)\n\n(## Citations\n.*)$", 1)
    return texts.select("doc_id", cites.alias("cites")).filter("cites <> ''")


@query(
    "strip_private_use",
    _EV + "SELECT doc_id, CASE WHEN user_id % 6 = 0 THEN 1 ELSE 0 END + marks AS removed, kept AS text FROM ("
    "SELECT doc_id, any_value(user_id) AS user_id, sum(CASE WHEN NOT has THEN 0 WHEN m = 1 THEN 4 ELSE 3 END) AS marks, "
    "string_agg(event_type || CASE WHEN NOT has THEN '' ELSE CASE m WHEN 0 THEN 'cite' || id1 WHEN 1 THEN 'cite' || id1 || ' ' || id2 "
    "WHEN 2 THEN 'Entity[\"t\",\"' || event_type || '\",\"x\"]' WHEN 3 THEN 'widget' || props || '  ' || event_type "
    "ELSE 'image_group{\"query\": [\"' || event_type || '\", \"q' || (event_id % 3) || '\"]}' END END, '' ORDER BY event_id) AS kept FROM ev GROUP BY 1)",
)
def strip_private_use(spark, sf_dir):
    return CL.strip_private_use(C.marked(spark, sf_dir))


@query(
    "cleaner_activation",
    _EV + f"SELECT mode, o.doc_id, mode = 'on' OR mode = 'auto' AND user_id % 10 <> 0 AS applied FROM orig o, (SELECT unnest(['off', 'auto', 'on']) AS mode)",
)
def cleaner_activation(spark, sf_dir):
    corpus = C.marked(spark, sf_dir)
    parts = [
        CL.cleaner_report(corpus, CleanerOptions(m)).select(F.lit(m).alias("mode"), "doc_id", "applied")
        for m in ("off", "auto", "on")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_REPORT = _EV + f""", done AS ({_CLEAN}), tags AS (
  SELECT doc_id, count(*) FILTER (has AND m < 2) AS cite, count(*) FILTER (has AND m = 2) AS entity,
         count(*) FILTER (has AND m = 3) AS unknown, count(*) FILTER (has AND m = 4) AS grp FROM ev GROUP BY 1),
report AS (
  SELECT o.doc_id, user_id % 10 <> 0 AS markers_detected, user_id % 10 <> 0 AS applied, user_id % 10 <> 0 AS was_modified,
    o.size AS original_size, length(text) AS cleaned_size, cite AS cite_markers, entity AS entity_markers,
    grp AS image_group_markers, unknown AS unknown_markers,
    (SELECT count(*) FROM src WHERE src.doc_id = o.doc_id) AS footnotes_emitted,
    CASE WHEN user_id % 10 <> 0 AND user_id % 6 = 0 THEN 1 ELSE 0 END AS leftover_pua_removed
  FROM orig o JOIN done USING (doc_id) JOIN tags USING (doc_id))
"""


@query("cleaner_report", _REPORT + "SELECT * FROM report")
def cleaner_report(spark, sf_dir):
    return CL.cleaner_report(C.marked(spark, sf_dir), CleanerOptions("auto"))


@query(
    "cleaner_totals",
    _REPORT + "SELECT count(*) AS documents, " + ", ".join(
        f"CAST(sum(CAST({c} AS BIGINT)) AS BIGINT) AS {c}"
        for c in ("markers_detected", "applied", "was_modified", "original_size", "cleaned_size", "cite_markers",
                  "entity_markers", "image_group_markers", "unknown_markers", "footnotes_emitted", "leftover_pua_removed")
    ) + " FROM report",
)
def cleaner_totals(spark, sf_dir):
    return CL.cleaner_totals(CL.cleaner_report(C.marked(spark, sf_dir), CleanerOptions("auto")))


# --- restructuring ------------------------------------------------------------------

_LINES = "(length(text) - length(replace(text, chr(10), '')))"


@query(
    "needs_formatting",
    f"SELECT doc_id, {_LINES} = 0 AND length(text) > 100 OR {_LINES} < 5 AND length(text) > 500 AS needs_formatting FROM documents",
)
def needs_formatting(spark, sf_dir):
    return G.needs_formatting(C.documents(spark, sf_dir))


@query("format_routing", f"SELECT doc_id, CASE WHEN {_LINES} > 20 THEN 'light' ELSE 'full' END AS path FROM documents")
def format_routing(spark, sf_dir):
    return G.format_routing(C.documents(spark, sf_dir))


_PIECES = {
    "head": "'[보고서] ' || s_name || ' 작성일: 2026-01-01수신: '",
    "to": "'B' || k || '. 주제: N' || s_nationkey || ' '",
    "h1": "'1. 서론 (개요)'",
    "h2": "'2.1. 시장 배경 '",
    "s1": "k || '건이다.'",
    "s2": "'내용:값 '",
    "h3": "'3.1.1. 세부 분석 '",
    "s3": "k || '.'",
    "note": "'[참고] 메모 ' || k || ' '",
    "item": "'• 항목 ' || k",
    "label": "'가정: 연 ' || k || '회 **굵:게** $a:b$ http://x.y/z 10:30 a::b '",
    "open": "'또한, 끝 ' || k",
}
_BR = "chr(10) || chr(10)"


def _flat_sql(changes: dict[str, str] | None = None, only: list[str] | None = None, column: str = "text") -> str:
    """The flat text with some of its pieces changed."""
    pieces = {**_PIECES, **(changes or {})}
    parts = [pieces[p] for p in (only or _PIECES)]
    return (
        f"SELECT s_suppkey AS doc_id, {' || '.join(parts)} AS {column} FROM (SELECT *, s_suppkey AS k FROM supplier)"
    )


def _step(name: str, changes: dict[str, str], step, shield: bool = False) -> None:
    @query(name, _flat_sql(changes))
    def run(spark, sf_dir):
        return G.rewrite(C.flat(spark, sf_dir), step, shield)


_step("colon_spacing", {"s2": "'내용: 값 '"}, FM.colon_spacing, shield=True)
_step("label_breaks", {"label": f"{_BR} || '- ' || " + _PIECES["label"]}, FM.label_breaks)
_step(
    "insert_headings",
    {"h1": f"{_BR} || '## 1. 서론 (개요)'", "h2": f"{_BR} || '### 2.1. 시장 배경 '", "h3": f"{_BR} || '#### 3.1.1. 세부 분석 '"},
    FM.insert_headings,
)
_step("insert_callouts", {"note": f"{_BR} || '> [참고] 메모 ' || k || ' '"}, FM.insert_callouts)
_step("insert_bullets", {"item": f"{_BR} || '- 항목 ' || k"}, FM.insert_bullets)
_step("split_sentences", {"s1": f"k || '건이다.' || {_BR}"}, FM.split_sentences)
_step("split_at_starters", {"open": f"{_BR} || '또한, 끝 ' || k"}, FM.split_at_starters)
_step("light_format", {"s2": "'내용: 값 '", "note": f"{_BR} || '> [참고] 메모 ' || k || ' '", "label": _PIECES["label"].replace("$a:b$", "$a: b$")}, FM.light_format)


@query("label_spacing", _flat_sql())
def label_spacing(spark, sf_dir):
    loose = F.regexp_replace("text", "(작성일|수신|주제|가정): ", "$1:   ")
    rows = C.flat(spark, sf_dir).withColumn("text", loose)
    return G.rewrite(rows, FM.label_spacing, shield=True)


@query(
    "protect_spans",
    "SELECT s_suppkey AS doc_id, 'bold' AS kind, 0 AS pos, '**굵:게**' AS span FROM supplier "
    "UNION ALL SELECT s_suppkey, 'math_inline', 0, '$a:b$' FROM supplier "
    "UNION ALL SELECT s_suppkey, 'math_block', 0, '$$' || s_name || '$$' FROM supplier",
)
def protect_spans(spark, sf_dir):
    rows = C.flat(spark, sf_dir).join(
        C.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS doc_id", "s_name"), "doc_id"
    )
    return G.protected_spans(rows.withColumn("text", F.concat("text", F.lit(" $$"), "s_name", F.lit("$$"))))


@query(
    "head_fields",
    "SELECT s_suppkey AS doc_id, 'title' AS key, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, '작성일', '2026-01-01' FROM supplier "
    "UNION ALL SELECT s_suppkey, '수신', 'B' FROM supplier UNION ALL SELECT s_suppkey, '주제', 'N' || s_nationkey FROM supplier",
)
def head_fields(spark, sf_dir):
    return G.head_fields(C.flat(spark, sf_dir))


_HEAD = (
    "'---' || chr(10) || 'title: \"' || s_name || '\"' || chr(10) || 'subtitle: \"N' || s_nationkey || '\"' || chr(10) "
    "|| 'date: \"2026-01-01\"' || chr(10) || 'recipient: \"B\"' || chr(10) || '---'"
)


@query("head_frontmatter", f"SELECT s_suppkey AS doc_id, {_HEAD} AS frontmatter FROM supplier")
def head_frontmatter(spark, sf_dir):
    return G.head_frontmatter(C.flat(spark, sf_dir))


@query(
    "tidy_markdown",
    "SELECT s_suppkey AS doc_id, 'a' || chr(10) || chr(10) || '# T' || s_suppkey || chr(10) || chr(10) || '$$' || chr(10) || chr(10) || 'x' || chr(10) || chr(10) || '$$' "
    "|| chr(10) || chr(10) || '> q' || chr(10) || chr(10) || '- i' AS text FROM supplier",
)
def tidy_markdown(spark, sf_dir):
    nl, crlf = "chr(10)", "chr(13) || chr(10)"
    rows = C.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS doc_id",
        f"'  a  ' || {crlf} || '# T' || s_suppkey || {nl} || '$$' || {nl} || 'x' || {nl} || '$$' || {nl} || '> q ' || {nl} || '- i' || {nl} || {nl} || {nl} AS text",
    )
    return G.rewrite(rows, FM.tidy)


@query(
    "format_corpus",
    _flat_sql(
        {
            "head": _HEAD + f" || {_BR}",
            "to": "k || '.'",
            "h1": f"{_BR} || '## 1. 서론 (개요)'",
            "h2": f"{_BR} || '### 2.1. 시장 배경 '",
            "s1": f"k || '건이다.' || {_BR}",
            "s2": "'내용: 값'",
            "h3": f"{_BR} || '#### 3.1.1. 세부 분석 '",
            "note": f"{_BR} || '> [참고] 메모 ' || k",
            "item": f"{_BR} || '- 항목 ' || k",
            "label": f"{_BR} || '- 가정: 연 ' || k || '회 **굵:게** $a:b$ http://x.y/z 10:30 a::b'",
            "open": f"{_BR} || '또한, 끝 ' || k",
        }
    ),
)
def format_corpus(spark, sf_dir):
    return G.format_corpus(C.flat(spark, sf_dir))


@query("format_documents")
def format_documents(spark, sf_dir):
    return G.format_corpus(C.documents(spark, sf_dir), CleanerOptions("auto"))


_AFTER_COLON = r"""list_transform(cs, lambda c, i: CASE WHEN c = ':' AND coalesce(cs[i - 1], '') <> ':' AND coalesce(cs[i + 1], '') <> ''
  AND NOT regexp_matches(cs[i + 1], '^[\s:/\\]$') AND NOT (regexp_matches(coalesce(cs[i - 1], ''), '^[0-9]$') AND regexp_matches(cs[i + 1], '^[0-9]$'))
  THEN ': ' ELSE c END)"""


@query(
    "colon_spacing_pages",
    rf"""WITH p AS (SELECT page_id, regexp_extract_all(html, '\*\*[^*]+?\*\*') AS bold, string_split(regexp_replace(html, '\*\*[^*]+?\*\*', chr(1), 'g'), '') AS cs FROM pages),
    spaced AS (SELECT page_id, bold, string_split(array_to_string({_AFTER_COLON}, ''), chr(1)) AS parts FROM p)
    SELECT page_id AS doc_id, array_to_string(list_transform(parts, lambda x, i: x || coalesce(bold[i], '')), '') AS text FROM spaced""",
)
def colon_spacing_pages(spark, sf_dir):
    rows = C.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return G.rewrite(rows, lambda t: FM.outside_bold(t, FM.colon_spacing))


# --- sources ---------------------------------------------------------------------------

@query("read_corpus_table", "SELECT doc_id, text FROM documents")
def read_corpus_table(spark, sf_dir):
    return RD.read_corpus_table(C.table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "read_corpus_parts",
    "SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1",
)
def read_corpus_parts(spark, sf_dir):
    return RD.read_corpus_table(C.table(spark, sf_dir, "conversations"), "conv_id", "text", order="turn")


def _files(spark, sf_dir):
    """Part names as files: encodings, suffixes, empty and broken ones."""
    name = "encode(p_name, 'UTF-8')"
    return C.table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS doc_id",
        "'in/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.MD' WHEN 1 THEN '.txt' ELSE '' END AS path",
        f"CASE p_partkey % 7 WHEN 0 THEN X'' WHEN 1 THEN NULL WHEN 2 THEN concat(X'504B0304', {name}) "
        f"WHEN 3 THEN concat({name}, X'0101') WHEN 4 THEN X'FF00FF' ELSE {name} END AS bytes",
        "CASE p_partkey % 5 WHEN 0 THEN 'DOCX' WHEN 1 THEN '.markdown' WHEN 2 THEN '.bin' END AS hint",
    )


_FORMAT = (
    "CASE p_partkey % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'md' ELSE CASE p_partkey % 7 WHEN 2 THEN 'docx' "
    "WHEN 5 THEN 'md' WHEN 6 THEN 'md' ELSE 'unknown' END END"
)


@query("detect_format", f"SELECT p_partkey AS doc_id, {_FORMAT} AS format FROM part")
def detect_format(spark, sf_dir):
    spark = RD.korean_session(spark)
    return RD.detect_format(_files(spark, sf_dir))


@query("detect_format_documents", "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'unknown' WHEN 2 THEN 'docx' ELSE 'md' END AS format FROM documents")
def detect_format_documents(spark, sf_dir):
    # no hint: plain text, text with control characters, a signature in front, and text again
    spark = RD.korean_session(spark)
    text = "encode(text, 'UTF-8')"
    rows = C.documents(spark, sf_dir).selectExpr(
        "doc_id", f"CASE doc_id % 4 WHEN 1 THEN concat({text}, encode(repeat(chr(1), length(text)), 'UTF-8')) WHEN 2 THEN concat(X'504B0304', {text}) ELSE {text} END AS bytes",
        "CAST(NULL AS STRING) AS hint",
    )
    return RD.detect_format(rows)


@query(
    "decode_text",
    "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN text END AS text, CASE WHEN doc_id % 4 = 3 THEN 'undecodable' END AS error "
    f"FROM ({_flat_sql({'item': _PIECES['item'].replace('•', '·')})})",
)
def decode_text(spark, sf_dir):
    spark = RD.korean_session(spark)
    # the Korean code page has no bullet sign, a middle dot it has
    flat = C.flat(spark, sf_dir).withColumn("text", F.translate("text", "•", "·"))
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.encode("text", "UTF-8"))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8")))
        .when(F.col("doc_id") % 4 == 2, F.encode("text", "MS949"))
        .otherwise(F.concat(F.encode("text", "UTF-8"), F.lit(b"\xff\xff")))
    )
    return RD.decode_text(flat.select("doc_id", raw.alias("bytes")))


@query(
    "validate_corpus",
    "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 7 < 2 THEN 'error' WHEN p_partkey % 3 = 0 THEN 'ok' ELSE 'warning' END AS status, "
    "CASE WHEN p_partkey % 7 = 0 THEN 'empty' WHEN p_partkey % 7 = 1 THEN 'missing' WHEN p_partkey % 3 <> 0 THEN 'suffix' END AS reason FROM part",
)
def validate_corpus(spark, sf_dir):
    return RD.validate_corpus(_files(spark, sf_dir)).drop("path")


def registry(spark) -> RT.TransformRegistry:
    """Branches for a mixed corpus, registered out of order."""
    reg = RT.TransformRegistry()
    reg.register("rest", F.col("format") != "unknown", lambda d: d.withColumn("text", F.lit("other")))
    reg.register("markdown", F.col("format") == "md", lambda d: d.withColumn("text", RD.decode_bytes(spark, F.col("bytes"))), priority=10)
    reg.register("markdown2", F.col("format") == "md", lambda d: d, priority=10)
    return reg


@query(
    "route_by_format",
    f"SELECT doc_id, CASE format WHEN 'md' THEN 'markdown' WHEN 'docx' THEN 'rest' END AS branch FROM (SELECT p_partkey AS doc_id, {_FORMAT} AS format FROM part)",
)
def route_by_format(spark, sf_dir):
    spark = RD.korean_session(spark)
    return registry(spark).route(RD.detect_format(_files(spark, sf_dir))).select("doc_id", "branch")


CONVERTED = (
    "SELECT doc_id, branch, CASE branch WHEN 'rest' THEN 'other' WHEN 'markdown' THEN txt END AS text, "
    "CASE WHEN branch IS NULL THEN 'no branch accepts the document' END AS error FROM ("
    f"SELECT p_partkey AS doc_id, CASE {_FORMAT} WHEN 'md' THEN 'markdown' WHEN 'docx' THEN 'rest' END AS branch, "
    "CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'PK' || chr(3) || chr(4) || p_name "
    "WHEN 3 THEN p_name || chr(1) || chr(1) WHEN 4 THEN NULL ELSE p_name END AS txt FROM part)"
)


def typed_files(spark, sf_dir):
    return _files(spark, sf_dir).withColumn("format", RD.format_of_bytes(spark, F.col("bytes"), F.col("hint")))


@query("convert_by_format", CONVERTED)
def convert_by_format(spark, sf_dir):
    spark = RD.korean_session(spark)
    return registry(spark).convert(typed_files(spark, sf_dir), "quarantine").select("doc_id", "branch", "text", "error")


@query(
    "extract_images",
    "SELECT p_partkey AS doc_id, 1 AS n, CASE WHEN p_partkey % 4 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime, "
    "'image_1' || CASE WHEN p_partkey % 4 = 0 THEN '.png' ELSE '.jpg' END AS file_name, p_name AS bytes FROM part WHERE p_partkey % 2 = 0",
)
def extract_images(spark, sf_dir):
    return WR.extract_images(C.pictures(spark, sf_dir)).withColumn("bytes", F.decode("bytes", "UTF-8"))


@query(
    "batch_outcome",
    "SELECT CASE WHEN s_suppkey % 4 = 3 THEN 'failed' ELSE 'succeeded' END AS status, count(*) AS documents FROM supplier GROUP BY 1",
)
def batch_outcome(spark, sf_dir):
    return RD.batch_outcome(decode_text(spark, sf_dir))
