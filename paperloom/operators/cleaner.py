"""Research-marker clean-up over ``(doc_id, text)``; all narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaner as C
from ..functions import constants as K
from ..functions.text import let
from ..options import CleanerOptions
from .structure import explode_rows

FOOTNOTE = CleanerOptions(activation_mode="auto")


def detect_markers(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", C.has_markers(F.col("text")).alias("has_markers"))


def marker_rows(corpus: DataFrame) -> DataFrame:
    """``markers(doc_id, pos, tag, payload)``; ``pos`` counts markers from 0."""
    marks = F.filter(C.pieces(F.col("text")), lambda p: p["tag"].isNotNull())
    out = explode_rows(corpus, ["doc_id"], marks, "pos", "m")
    return out.select("doc_id", "pos", "m.tag", "m.payload")


def cite_numbers(corpus: DataFrame) -> DataFrame:
    """``cite_ids(doc_id, source_id, num)`` numbered by first appearance."""
    out = explode_rows(corpus, ["doc_id"], C.source_order(C.pieces(F.col("text"))), "p", "source_id")
    return out.select("doc_id", "source_id", (F.col("p") + 1).alias("num"))


def cite_texts(corpus: DataFrame, options: CleanerOptions) -> DataFrame:
    """Replacement of every citation marker in the chosen mode."""
    texts = let(
        C.pieces(F.col("text")),
        lambda p: let(
            C.source_order(p),
            lambda o: F.transform(
                F.filter(p, lambda x: x["tag"] == "cite"),
                lambda x: C.cite_text(x["payload"], o, options.cite_mode),
            ),
        ),
    )
    return explode_rows(corpus, ["doc_id"], texts, "pos", "replacement")


def entity_texts(corpus: DataFrame) -> DataFrame:
    rows = marker_rows(corpus).filter("tag = 'entity'")
    return rows.select("doc_id", "pos", C.entity_text(F.col("payload")).alias("replacement"))


def image_group_texts(corpus: DataFrame) -> DataFrame:
    rows = marker_rows(corpus).filter("tag = 'image_group'")
    return rows.select("doc_id", "pos", C.image_group_text(F.col("payload")).alias("replacement"))


def unknown_marker_texts(corpus: DataFrame, options: CleanerOptions = FOOTNOTE) -> DataFrame:
    rows = marker_rows(corpus).filter("tag not in ('cite', 'entity', 'image_group')")
    return rows.select(
        "doc_id", "pos", C.unknown_text(F.col("tag"), F.col("payload"), options.drop_unknown_markers).alias("replacement")
    )


def clean_corpus(corpus: DataFrame, options: CleanerOptions = FOOTNOTE) -> DataFrame:
    """Cleaned texts; inactive documents pass through untouched."""
    return corpus.select("doc_id", C.clean_text(F.col("text"), options).alias("text"))


def strip_private_use(corpus: DataFrame) -> DataFrame:
    """Remove private-use leftovers and count them."""
    clean = F.regexp_replace(F.col("text"), F.lit(K.MARK_RANGE), F.lit(""))
    return corpus.select(
        "doc_id", clean.alias("text"), (F.length("text") - F.length(clean)).alias("removed")
    )


def cleaner_report(corpus: DataFrame, options: CleanerOptions = FOOTNOTE) -> DataFrame:
    """Counters per document."""
    return corpus.select("doc_id", C.report(F.col("text"), options).alias("r")).select("doc_id", "r.*")


def cleaner_totals(report: DataFrame) -> DataFrame:
    """Corpus totals of a report."""
    sums = [F.sum(F.col(c).cast("bigint")).alias(c) for c in report.columns if c != "doc_id"]
    return report.agg(F.count("*").alias("documents"), *sums)
