"""Report corpora derived from the base tables.

Text is assembled from table rows, so its relations are known from the tables
themselves and every operator can be checked against plain SQL.  What belongs
to a document follows from its own rows, never from the size of the tables:
one report per customer, one marked text per user and month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K

KEY_STEP = 100_000_000
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STRAY = "\ue20a"  # a private-use leftover outside any marker
BOX_LINE = "┌" + "─" * 22 + "┐"
BOX_SHORT = "┌" + "─" * 6 + "┐"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: counts, latest date, ordered table rows."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS k", "o_orderkey", "o_orderstatus AS status",
        "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS price",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "o_orderpriority AS priority",
    )
    counts = [
        F.count_if(F.col("priority") == p).alias(f"p{i}") for i, p in enumerate(PRIORITIES)
    ]
    facts = orders.groupBy("k").agg(
        F.count("*").alias("n"),
        F.max("day").alias("last_day"),
        F.array_sort(F.collect_list(F.struct("o_orderkey", "status", "price", "day"))).alias("rows"),
        *counts,
    )
    customer = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS k", "c_name", "c_mktsegment AS seg",
        "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) AS acct",
    )
    return facts.join(customer, "k").withColumn("doc_id", F.col("k"))


# (condition, line); a None line stands for the ordered order rows
_LINES: list[tuple[str, str | None]] = [
    ("k % 3 = 0", "'---'"),
    ("k % 3 = 0", "'title: ' || c_name || ' - order report'"),
    ("k % 3 = 0", "'sector: ' || seg || CASE WHEN edited AND k % 5 = 1 THEN 'X' ELSE '' END"),
    ("k % 3 = 0", "'desk: D' || (k % 7)"),
    ("k % 6 = 0", "'Desk: \"E' || (k % 5) || '\"'"),
    ("k % 3 = 0", "'---'"),
    ("k % 3 = 0", "''"),
    ("true", "'# ' || c_name || ' - order report'"),
    ("true", "''"),
    ("k % 3 <> 0", "'## Segment ' || seg"),
    ("k % 3 <> 0", "''"),
    ("k % 3 = 0", "'**작성자:** Analyst ' || (k % 4)"),
    ("k % 3 = 0", "''"),
    ("k % 3 = 0", "'**As of: ' || last_day || '**'"),
    ("k % 3 = 0", "''"),
    ("k % 3 = 0", "'**Recipient:** Desk ' || (k % 5)"),
    ("k % 3 <> 0", "'**Report date:** ' || last_day"),
    ("k % 3 <> 0", "''"),
    ("k % 3 <> 0", "'**Sector**: ' || seg || CASE WHEN edited AND k % 5 = 1 THEN 'X' ELSE '' END"),
    ("k % 3 = 1", "''"),
    ("k % 3 = 1", "'- intro'"),
    ("k % 3 = 1", "''"),
    ("k % 3 = 1", "'**Recipient:** Desk ' || (k % 5)"),
    ("true", "''"),
    ("true", "'## 1. Overview'"),
    ("true", "''"),
    ("true", "'Customer **' || k || '** has'"),
    ("true", "'*' || n || '* orders^1^ and $x_' || k || '$.'"),
    ("true", "''"),
    ("true", "'<a id=\"m' || k || '\"></a>Balance  is ' || acct || '<br>'"),
    ("true", "'next ( line ) of ' || k || chr(92)"),
    ("true", "'<span style=\"color:#a1b2c3\">tint ' || k || '</span> and H~2~O ' || chr(92) || '[done' || chr(92) || ']'"),
    ("true", "''"),
    ("true", "'### Detail'"),
    ("edited AND k % 5 = 4", "'### Detail'"),
    ("true", "''"),
    ("true", "'| Order | Status | ' || element_at(array('Revenue 2025', 'Impact', 'CMR', 'Amount', 'Upside'), CAST(k % 5 AS INT) + 1) || ' | Date |'"),
    ("k % 17 <> 0", "'|---|:---:|---:|---|'"),
    ("k % 17 = 0", "'|---|:---:|'"),
    ("true", None),
    ("k % 11 = 0", "'| ' || k || ' | Z | 1 | 2 | extra ' || k || ' |'"),
    ("k % 13 = 0", "'| ' || k || ' | short |'"),
    ("true", "''"),
    ("true", "'> [NOTE] Balance ' || acct"),
    ("true", "'> second line'"),
    ("true", "''"),
    *[(f"p{i} > 0", f"'- {p}: ' || p{i}") for i, p in enumerate(PRIORITIES)],
    ("true", "'  - nested ' || k"),
    ("true", "''"),
    ("true", "'1. first item of ' || k || ', kept as a list.'"),
    ("true", "''"),
    ("true", "'2. Closing remarks'"),
    ("true", "''"),
    ("NOT (edited AND k % 5 = 2)", "CASE WHEN k % 2 = 0 THEN '---' ELSE '## ---' END"),
    ("true", "''"),
    ("true", "'```sql'"),
    ("true", "'# not a heading ' || k || CASE WHEN edited AND k % 5 = 3 THEN ' changed' ELSE '' END"),
    ("true", "'| a | b |'"),
    ("k % 6 = 0", f"'{BOX_LINE}'"),
    ("k % 6 = 3", f"'{BOX_SHORT}'"),
    ("true", "'```'"),
    ("true", "''"),
    ("k % 9 = 0", "'```diagram:flow'"),
    ("k % 9 = 0", "'title: D' || k"),
    ("k % 9 = 0", "'```'"),
    ("k % 9 = 0", "''"),
    ("true", "'$$y_' || k || '=1$$'"),
    ("true", "''"),
    ("true", "'$$'"),
    ("true", "'z_' || k"),
    ("true", "'$$'"),
    ("true", "''"),
    ("true", "'![chart ' || k || '](img/' || k || '.png)'"),
    ("true", "''"),
    ("k % 2 = 0", "'**7. Annex ' || k || '**'"),
    ("k % 2 = 0", "''"),
    ("true", "'tail note.2 of ' || k"),
    ("true", "''"),
    ("true", "'## Sources'"),
    ("true", "'1. orders of ' || k"),
    ("true", "'2. unused note'"),
    ("k % 2 = 1", "'2. last note ' || k"),
    ("true", "''"),
    ("k % 4 = 0", "'#### Appendix ' || k"),
]

_ROW = """transform(rows, r -> '| ' || r.o_orderkey || ' | ' || r.status || ' | ' ||
  CASE k % 5 WHEN 1 THEN element_at(array('High','Medium','Low'), CAST(r.o_orderkey % 3 AS INT) + 1)
             WHEN 3 THEN '(' || r.price || ')' WHEN 4 THEN '-' || r.price ELSE r.price END
  || ' | ' || r.day || ' |')"""


def _report_text(edited: bool):
    groups: list[str] = []
    plain: list[str] = []

    def flush() -> None:
        if plain:
            groups.append("filter(array(" + ", ".join(plain) + "), x -> x IS NOT NULL)")
            plain.clear()

    for cond, line in _LINES:
        if line is None:
            flush()
            groups.append(_ROW)
        else:
            plain.append(f"CASE WHEN {cond} THEN {line} END")
    flush()
    sql = f"array_join(concat({', '.join(groups)}), '\\n')"
    return F.expr(sql.replace("edited", "true" if edited else "false"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown report per customer: ``(doc_id, text)``."""
    return _report_facts(spark, sf_dir).select("doc_id", _report_text(False).alias("text"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The reports twice, the second time with one edit per document."""
    facts = _report_facts(spark, sf_dir)
    return (
        facts.select("doc_id", _report_text(False).alias("text")),
        facts.select("doc_id", _report_text(True).alias("text")),
    )


def both_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two versions of a report in one row: ``(doc_id, text, new_text)``."""
    return _report_facts(spark, sf_dir).select("doc_id", _report_text(False).alias("text"), _report_text(True).alias("new_text"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event texts with research markers, one per user and month."""
    mark = (
        "CASE WHEN user_id % 10 = 0 THEN '' ELSE CASE event_id % 5 "
        "WHEN 0 THEN o || 'cite' || s || 'e' || (event_id % 9) || c "
        "WHEN 1 THEN o || 'cite' || s || 'e' || (event_id % 9) || s || ' e' || (event_id % 7) || c "
        "WHEN 2 THEN o || 'Entity' || s || '[\"t\",\"' || event_type || '\",\"x\"]' || c "
        "WHEN 3 THEN o || 'widget' || s || props || '  ' || event_type || c "
        "ELSE o || 'image_group' || s || '{\"query\": [\"' || event_type || '\", \"q' || (event_id % 3) || '\"]}' || c END END"
    )
    for name, char in (("o", K.MARK_OPEN), ("s", K.MARK_SEP), ("c", K.MARK_CLOSE)):
        mark = mark.replace(f" {name} ", f" '{char}' ")
    events = table(spark, sf_dir, "events").select(
        "user_id", (F.year("ts") * 12 + F.month("ts")).alias("month"), "event_id",
        F.expr(f"event_type || {mark}").alias("piece"),
    )
    pieces = events.groupBy("user_id", "month").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "piece"))).alias("p")
    )
    text = F.concat(
        F.array_join(F.transform("p", lambda x: x["piece"]), ""),
        F.when(F.col("user_id") % 6 == 0, F.lit(STRAY)).otherwise(F.lit("")),
    )
    return pieces.select(
        (F.col("user_id") * KEY_STEP + F.col("month")).alias("doc_id"), text.alias("text")
    )


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-line report texts, one per supplier."""
    k = "s_suppkey"
    parts = [
        "'[보고서] ' || s_name || ' 작성일: 2026-01-01수신: '",
        f"'B' || {k} || '. 주제: N' || s_nationkey || ' 1. 서론 (개요)'",
        f"'2.1. 시장 배경 ' || {k} || '건이다.내용:값 '",
        f"'3.1.1. 세부 분석 ' || {k} || '.[참고] 메모 ' || {k} || ' • 항목 ' || {k}",
        f"'가정: 연 ' || {k} || '회 **굵:게** $a:b$ http://x.y/z 10:30 a::b 또한, 끝 ' || {k}",
    ]
    return table(spark, sf_dir, "supplier").select(
        F.col(k).alias("doc_id"), F.expr(" || ".join(parts)).alias("text")
    )


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image line per part, embedded for even keys (wrapped over lines for multiples of four)."""
    data = "base64(encode(p_name, 'UTF-8'))"
    line = (
        "CASE WHEN p_partkey % 4 = 0 THEN '![' || p_name || '](data:image/png;base64,' || "
        f"left({data}, 4) || chr(10) || substr({data}, 5) || ')' "
        f"WHEN p_partkey % 2 = 0 THEN '![' || p_name || '](data:image/jpeg;base64,' || {data} || ')' "
        "ELSE '![' || p_name || '](img/' || p_partkey || '.png)' END"
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(line).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")
