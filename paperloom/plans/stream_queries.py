"""Queries that write: streaming runs of batch operators, and sinks read back."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import audit as AU
from ..operators import office as W
from ..operators import render as R
from ..operators import structure as S
from ..sources import readers as RD
from ..sources import versions as V
from ..sources import writers as WR
from ..streaming import ingest as ST
from . import corpora as C
from . import oracles as O
from . import text_queries as TQ
from .registry import query


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share; a local session may do without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf_dir):
    """The reports as a stream of files."""
    source = scratch(spark, "reports")
    C.reports(spark, sf_dir).write.parquet(source)
    return spark.readStream.schema("doc_id long, text string").parquet(source)


@query("ingest_stream", O.typed("true", "doc_id, block_idx, type, text"))
def ingest_stream(spark, sf_dir):
    target, checkpoint = scratch(spark, "blocks"), scratch(spark, "state")
    ST.ingest(_stream(spark, sf_dir), "blocks", target, checkpoint).awaitTermination()
    return spark.read.parquet(target).select("doc_id", "block_idx", "type", "text")


@query("audit_stream", O.BASE + "SELECT doc_id, type, count(*) AS n FROM blk WHERE in_body GROUP BY 1, 2")
def audit_stream(spark, sf_dir):
    target, checkpoint = scratch(spark, "counts"), scratch(spark, "state")
    ST.ingest_batches(
        _stream(spark, sf_dir), lambda b: AU.block_counts(S.body_blocks(b)), target, checkpoint
    ).awaitTermination()
    return spark.read.parquet(target).select("doc_id", "type", "n")


@query("write_markdown_corpus", "SELECT doc_id, text AS markdown FROM documents")
def write_markdown_corpus(spark, sf_dir):
    rendered = C.documents(spark, sf_dir).withColumnRenamed("text", "markdown")
    return spark.read.parquet(WR.write_markdown_corpus(rendered, scratch(spark, "markdown"), "one"))


@query(
    "write_document_tables",
    O.with_(O.DOC, O.BLK, O.TROW, O.RUNS, O.NOTES) + "SELECT 'blocks' AS relation, count(*) AS n FROM blk UNION ALL SELECT 'documents', count(*) FROM doc "
    "UNION ALL SELECT 'footnotes', count(*) FROM notes UNION ALL SELECT 'tables', count(*) FROM blk WHERE type = 'TABLE' "
    "UNION ALL SELECT 'table_cells', count(*) FROM cell UNION ALL SELECT 'runs', (SELECT count(*) FROM runs) + (SELECT count(*) FROM cell WHERE text <> '')",
)
def write_document_tables(spark, sf_dir):
    base, corpus = scratch(spark, "tables"), C.reports(spark, sf_dir)
    for _ in range(2):  # the second run replaces the first
        WR.write_document_tables(corpus, base, "reports")
    parts = [
        spark.read.parquet(f"{base}/{name}").groupBy(F.lit(name).alias("relation")).agg(F.count("*").alias("n"))
        for name in ("blocks", "documents", "footnotes", "tables", "table_cells", "runs")
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _changed(spark, sf_dir, edited: str, removed: str = "false"):
    """The reports, some of them edited, some gone."""
    both = C.both_versions(spark, sf_dir)
    return both.select("doc_id", "text"), both.filter(f"NOT ({removed})").select("doc_id", F.expr(f"CASE WHEN {edited} THEN new_text ELSE text END").alias("text"))


_LEFT = "doc_id % 50 <> 7"


@query(
    "update_document_tables",
    O.with_(O.DOC, O.BLK, O.TROW, O.RUNS, O.NOTES) + f""", n AS (SELECT 'blocks' AS relation, count(*) AS n FROM blk WHERE {_LEFT}
    UNION ALL SELECT 'documents', count(*) FROM doc WHERE {_LEFT} UNION ALL SELECT 'footnotes', count(*) FROM notes WHERE {_LEFT}
    UNION ALL SELECT 'tables', count(*) FROM blk WHERE type = 'TABLE' AND {_LEFT} UNION ALL SELECT 'table_cells', count(*) FROM cell WHERE {_LEFT}
    UNION ALL SELECT 'runs', (SELECT count(*) FROM runs WHERE {_LEFT}) + (SELECT count(*) FROM cell WHERE text <> '' AND {_LEFT}))
    SELECT *, true AS same_as_whole, (SELECT count(*) FROM doc WHERE {_LEFT} AND k % 20 = 6) AS parsed, 2 AS generation FROM n""",
)
def update_document_tables(spark, sf_dir):
    root = scratch(spark, "corpus")
    before, after = _changed(spark, sf_dir, "doc_id % 20 = 6", "doc_id % 50 = 7")
    V.update_document_tables(before, root)
    told = V.update_document_tables(after, root)
    whole = V.parsed_tables(after, scratch(spark, "parsed"))
    parts = []
    for name, rows in whole.items():
        said = [V.row_digest(df, rows.columns) for df in (V.read_relation(spark, root, name), rows)]
        both = said[0].crossJoin(said[1].select(F.struct("n", "digest").alias("other")))  # one row each
        parts.append(both.select(F.lit(name).alias("relation"), "n", F.struct("n", "digest").eqNullSafe(F.col("other")).alias("same_as_whole")))
    return reduce(lambda a, b: a.unionByName(b), parts).select("*", F.lit(told["parsed"]).cast("long").alias("parsed"), F.lit(told["generation"]).alias("generation"))


@query(
    "audit_incremental",
    O.with_(O.DOC) + "SELECT doc_id, CASE WHEN k % 10 < 3 AND NOT (k % 5 = 0 OR k % 5 = 1 AND k % 3 = 0) THEN 'FAIL' ELSE 'PASS' END AS status FROM doc",
)
def audit_incremental(spark, sf_dir):
    root = scratch(spark, "corpus")
    for corpus in _changed(spark, sf_dir, "doc_id % 10 < 3"):
        V.update_document_tables(corpus, root, V.no_tables)
    return V.audit_incremental(spark, root, 1, 2)


@query(
    "audit_stream_changes",
    O.BASE + """SELECT type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents
    FROM (SELECT doc_id, type FROM blk WHERE in_body UNION ALL SELECT doc_id, 'HEADING_3' FROM doc WHERE k % 10 = 4)
    GROUP BY 1""",
)
def audit_stream_changes(spark, sf_dir):
    """All reports, then some of them again, then edited ones (a heading more), over three runs of one stream."""
    source, target, checkpoint = scratch(spark, "changes"), scratch(spark, "deltas"), scratch(spark, "state")
    before, after = C.versions(spark, sf_dir)
    deliveries = [(before, 1), (before.filter("doc_id % 3 = 0"), 1), (after.filter("doc_id % 10 = 4"), 2), (before.filter("doc_id % 10 = 4"), 1)]
    for rows, version in deliveries:
        rows.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string, version long").parquet(source)
        ST.follow_counts(stream, target, checkpoint).awaitTermination()  # a restart from the checkpoint each time
    return ST.current_counts(spark.read.parquet(target)).groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


@query("convert_once", TQ.CONVERTED)
def convert_once(spark, sf_dir):
    spark = RD.korean_session(spark)
    typed = TQ.typed_files(spark, sf_dir)
    return TQ.registry(spark).convert_once(typed, scratch(spark, "branches"), "quarantine").select("doc_id", "branch", "text", "error")


@query("read_corpus_files", "SELECT 'Report of ' || s_name || chr(10) || chr(10) || s_suppkey AS text, count(*) AS files FROM supplier GROUP BY 1")
def read_corpus_files(spark, sf_dir):
    """One text file per supplier in one folder, written and read by Spark."""
    folder, own = scratch(spark, "files"), RD.korean_session(spark)
    texts = C.table(spark, sf_dir, "supplier").select(F.concat(F.lit("Report of "), "s_name", F.lit("\n\n"), F.col("s_suppkey").cast("string")).alias("value"))
    # a file each: shares of the rows on all cores, whose tasks put their files in place themselves instead of the driver
    shares = texts.repartition(4 * spark.sparkContext.defaultParallelism, "value")
    shares.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("lineSep", "\u0000").text(folder)
    read = RD.decode_text(RD.read_corpus_files(own, folder, "*.txt")).filter("error IS NULL")
    return read.groupBy(F.rtrim(F.col("text"), F.lit("\u0000")).alias("text")).agg(F.countDistinct("doc_id").alias("files"))


@query(
    "render_outcome",
    """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 6 = 2 THEN 1 ELSE 2 END AS rendered, CASE WHEN p_partkey % 6 = 2 THEN 1 ELSE 0 END AS failed,
      CASE WHEN p_partkey % 6 = 2 THEN 'incomplete' ELSE 'complete' END AS status,
      CASE WHEN p_partkey % 6 = 2 THEN '## Part ' || p_partkey || chr(10) || chr(10) || '[Render Error: IMAGE]' || chr(10) END AS shown FROM part""",
)
def render_outcome(spark, sf_dir):
    """Pictures below a heading, some with data that can't be decoded."""
    bad = F.lit("![bad](data:image/png;base64,QUJDR)")
    text = F.concat(F.lit("## Part "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.when(F.col("doc_id") % 6 == 2, bad).otherwise(F.col("text")))
    rendered = R.render_outcome(S.segment_blocks(C.pictures(spark, sf_dir).withColumn("text", text)))
    shown = R.assemble_from_blocks(rendered).withColumnRenamed("markdown", "shown")
    counts = R.outcome_counts(rendered).withColumns({c: F.col(c).cast("int") for c in ("rendered", "failed")})
    return counts.join(shown, "doc_id").withColumn("shown", F.when(F.col("failed") > 0, F.col("shown")))


@query(
    "style_chain_stored",
    """SELECT o_orderkey // 1000 AS package, 's' || o_orderkey AS style_id,
      CASE o_orderkey // 1000 % 3 WHEN 0 THEN CASE WHEN o_orderkey % 1000 >= 400 THEN 3 ELSE 2 END
        WHEN 1 THEN NULL ELSE CASE WHEN o_orderkey % 1000 >= 700 THEN 1 END END AS level FROM orders""",
)
def style_chain_stored(spark, sf_dir):
    """A style per order, based on the one before: chains of 1,000 with a level at the start or within, and cycles."""
    styles = C.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey DIV 1000 AS package", "'s' || o_orderkey AS style_id",
        "CASE WHEN o_orderkey DIV 1000 % 3 = 0 AND o_orderkey % 1000 = 0 THEN 'heading 2' WHEN o_orderkey DIV 1000 % 3 = 0 AND o_orderkey % 1000 = 400 THEN 'heading 3' END AS name",
        "CASE WHEN o_orderkey % 1000 <> 0 THEN 's' || (o_orderkey - 1) WHEN o_orderkey DIV 1000 % 3 = 1 THEN 's' || (o_orderkey + 499) END AS base_style_id",
        "CASE WHEN o_orderkey DIV 1000 % 3 = 2 AND o_orderkey % 1000 = 700 THEN 0 END AS outline_lvl",
    )
    return W.style_levels_stored(styles, scratch(spark, "styles"), ["package"])
