"""New files through the same per-document expressions, exactly once.

Parsing is local to a document, so a stream of new documents needs no state: every file is a row, and the batch
expressions apply unchanged in append mode. Documents that come again or changed (``follow_counts``) keep a small state
each: the version, digest and block counts that they stand for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import exprs as E
from ..functions import lexer as L
from ..functions.text import count_char
from ..operators import footnotes as N
from ..operators import inline as I
from ..operators import metadata as MD
from ..operators import structure as S
from ..operators import tables as T
from ..sources.readers import decode_bytes

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"

RELATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "blocks": S.blocks,
    "documents": MD.infer_metadata,
    "runs": lambda corpus: I.block_runs(S.segment_blocks(corpus)),
    "tables": lambda corpus: T.tables(S.segment_blocks(corpus)),
    "table_cells": lambda corpus: T.table_cells(S.segment_blocks(corpus)),
    "footnotes": N.footnote_defs,
}


def stream_files(spark: SparkSession, directory: str, pattern: str = "*.md") -> DataFrame:
    """Watched directory as a streaming corpus ``(doc_id, path, text)``."""
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).load(directory)
    )
    text = decode_bytes(spark, F.col("content"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", text.alias("text"))


def stream_table(spark: SparkSession, path: str, doc_id: str, text: str) -> DataFrame:
    """Parquet folder that grows, as a streaming corpus ``(doc_id, text)``."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def ingest(corpus: DataFrame, relation: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append one relation of the new documents to a parquet table, then stop.

    Source offsets and written files are tracked in ``checkpoint``; a restarted
    query neither skips nor repeats a file.
    """
    rows = RELATIONS[relation](corpus.filter(F.col("text").isNotNull()))
    return (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def ingest_batches(
    corpus: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> StreamingQuery:
    """Run a batch step that needs windows or aggregates on every micro-batch.

    A batch overwrites its own partition, so a retried batch leaves one copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = step(batch).withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        corpus.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


#: Block types in the order of the counts that ``follow_counts`` keeps.
COUNTED = {kind: "".join(code for code, of in L.TYPES.items() if of == kind) for kind in sorted(set(L.TYPES.values()))}


def follow_counts(corpus: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append to ``target`` what documents newly stand for: ``(doc_id, version, digest, counts)``, counts by block type.

    ``corpus`` is a stream ``(doc_id, version, text)`` in which documents may come again, changed, late or in several
    batches. Of a document the greatest version counts (of equal ones, the greatest digest), once: what comes again or late
    adds no row, and a newer row replaces the former ones (``current_counts``). Texts are parsed once, before the state; the
    state is a streaming aggregate, one row of a few numbers per document. A row without id or version is left out, a null
    text is a document without blocks. A batch overwrites its own folder, so a retried batch leaves one copy.
    """
    rows = corpus.filter("doc_id IS NOT NULL AND version IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    codes = F.array_join(F.transform(E.body_spans(), lambda b: b["code"]), "")
    # a generated row is evaluated once, however often it is read
    said = rows.select("doc_id", "version", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.explode_outer(F.array(codes)).alias("codes"))
    counts = F.array(*(count_char(F.col("codes"), of) for of in COUNTED.values()))
    # of equal rows the first delivery stays, so that the newest row tells whether this batch brought it
    newest = F.struct("version", "digest", (-F.unix_micros(F.current_timestamp())).alias("since"), counts.alias("counts"))
    state = said.select("doc_id", newest.alias("row")).groupBy("doc_id").agg(F.max("row").alias("row"))
    fresh = state.filter(F.col("row.since") == -F.unix_micros(F.current_timestamp()))
    by_type = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, COUNTED)), F.col("row.counts")), lambda _, n: n > 0)
    changes = fresh.select("doc_id", "row.version", "row.digest", by_type.alias("counts"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )


def current_counts(changes: DataFrame) -> DataFrame:
    """``(doc_id, type, n)``: what documents stand for after all changes."""
    newest = changes.groupBy("doc_id").agg(F.max_by("counts", F.struct("version", "digest")).alias("counts"))
    return newest.select("doc_id", F.explode("counts").alias("type", "n")).withColumn("n", F.col("n").cast("long"))
