"""Corpora from files and tables, format detection, decoding and validation.

A corpus row is ``(doc_id, path, bytes)`` or ``(doc_id, text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import let, lookup

CONTROL_SHARE = 0.05
KOREAN_SETTINGS = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")


def korean_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that can decode the Korean code page.

    The code page needs the JVM's own charsets, and bad bytes must become U+FFFD instead of an error. Both are settings
    of a session, and every ``decode`` in it obeys them, so they are made in a session of their own: read the corpus in
    it, and leave the one that it came from as it is. Other settings made at run time are taken along.
    """
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        value = spark.conf.get(key, None)
        if value is not None:
            own.conf.set(key, value)
    for key in KOREAN_SETTINGS:
        own.conf.set(key, "true")
    return own


def read_corpus_files(spark: SparkSession, directory: str, pattern: str = "*.md") -> DataFrame:
    """All matching files of one directory: ``(doc_id, path, bytes)``.

    An empty directory is an error; one file name is looked at for that.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "false")
        .load(directory)
    )
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no {pattern} files in {directory}")
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").alias("bytes"))


def read_corpus_table(table: DataFrame, doc_id: str, text: str, order: str | None = None) -> DataFrame:
    """Any table with a text or binary column as a corpus ``(doc_id, text)``.

    With ``order`` the rows of one ``doc_id`` are parts of one document, joined
    by blank lines; a document is then as large as its parts together.
    """
    rows = table.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([order] if order else []))
    if dict(rows.dtypes)["text"] == "binary":
        rows = rows.withColumn("text", decode_bytes(table.sparkSession, F.col("text")))
    if order is None:
        return rows
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


# --- decoding -----------------------------------------------------------------

def _korean(spark: SparkSession, data: Column) -> Column:
    """Text in the Korean code page, null where a byte does not fit."""
    if any(str(spark.conf.get(key, "false")).lower() != "true" for key in KOREAN_SETTINGS):
        raise ValueError("decoding needs the settings of korean_session(); read the corpus in such a session")
    return let(
        F.decode(data, "MS949"), lambda t: F.when(~F.contains(t, F.lit("\ufffd")), t)
    )


def decode_bytes(spark: SparkSession, data: Column) -> Column:
    """UTF-8 (with or without mark), else Korean; null when neither fits. Needs a ``korean_session``."""
    bom = F.substring(data, 1, 3) == F.lit(b"\xef\xbb\xbf")
    body = F.when(bom, F.substring(data, F.lit(4), F.length(data))).otherwise(data)
    return F.when(F.is_valid_utf8(body.cast("string")), F.decode(body, "UTF-8")).when(
        ~bom, _korean(spark, data)
    )


def decode_text(corpus: DataFrame) -> DataFrame:
    """``(doc_id, text, error)``; undecodable documents keep a reason instead of failing the job."""
    text = decode_bytes(corpus.sparkSession, F.col("bytes"))
    out = corpus.select("doc_id", text.alias("text"))
    return out.withColumn("error", F.when(F.col("text").isNull(), F.lit("undecodable")))


# --- formats --------------------------------------------------------------------

def format_of_extension(ext: Column) -> Column:
    low = F.lower(ext)
    return lookup(F.when(low.startswith("."), low).otherwise(F.concat(F.lit("."), low)), K.EXTENSION_FORMATS)


def _is_text(spark: SparkSession, data: Column) -> Column:
    text = F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")).otherwise(
        _korean(spark, data)
    )
    control = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
    return let(
        text,
        lambda t: t.isNotNull()
        & (
            (F.length(t) - F.length(F.regexp_replace(t, F.lit(control), F.lit(""))))
            / F.greatest(F.length(t), F.lit(1))
            < CONTROL_SHARE
        ),
    )


def format_of_bytes(spark: SparkSession, data: Column, hint: Column) -> Column:
    """``docx``, ``md`` or ``unknown``: hint, then signature, then whether all of it is text."""
    return (
        F.when(format_of_extension(hint).isNotNull(), format_of_extension(hint))
        .when(data.isNull() | (F.length(data) == 0), F.lit("unknown"))
        .when(F.substring(data, 1, 4) == F.lit(b"PK\x03\x04"), F.lit("docx"))
        .when(_is_text(spark, data), F.lit("md"))
        .otherwise(F.lit("unknown"))
    )


def detect_format(corpus: DataFrame) -> DataFrame:
    """``(doc_id, format)`` of ``(doc_id, bytes, hint)``."""
    return corpus.select(
        "doc_id", format_of_bytes(corpus.sparkSession, F.col("bytes"), F.col("hint")).alias("format")
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\.](\.[^./\\]*)$", 1))


def validate_corpus(corpus: DataFrame, suffix: str = ".md") -> DataFrame:
    """``(doc_id, path, status, reason)``: missing or empty input fails, a foreign suffix only warns."""
    size = F.length("bytes")
    reason = (
        F.when(F.col("bytes").isNull(), F.lit("missing"))
        .when(size == 0, F.lit("empty"))
        .when(extension(F.col("path")) != suffix, F.lit("suffix"))
    )
    status = (
        F.when(F.col("bytes").isNull() | (size == 0), F.lit("error"))
        .when(extension(F.col("path")) != suffix, F.lit("warning"))
        .otherwise(F.lit("ok"))
    )
    return corpus.select("doc_id", "path", status.alias("status"), reason.alias("reason"))


def batch_outcome(results: DataFrame) -> DataFrame:
    """Documents that went well and that failed, from an ``error`` column."""
    status = F.when(F.col("error").isNull(), F.lit("succeeded")).otherwise(F.lit("failed"))
    return results.groupBy(status.alias("status")).agg(F.count("*").alias("documents"))
