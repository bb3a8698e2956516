"""A training corpus from ``documents``: five stages, each one operator of ``paperloom.llm`` over all rows that the stage
before has kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``; the last one adds the copy number,
the number of copies and the key that the mixture is shuffled by. ``run`` writes each result to the folder that all
executors share and reads it again for the next stage. Null, empty, repeated and very long texts, null ids and empty
tables have the results that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import free_name, stored, table
from paperloom.llm.decontaminate import decontaminate
from paperloom.llm.exact_dedup import exact_dedup
from paperloom.llm.jaccard import near_dedup
from paperloom.llm.mixing import mix_sources
from paperloom.llm.toxicity import TOXIC_FROM, score_toxicity, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold stay."""
    score = free_name(docs, "toxicity")
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col(score)["score"] < TOXIC_FROM).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays."""
    return near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources get their target shares, in random order."""
    added = ("copy", "n_copies", "shuffle_key")
    return mix_sources(docs).select("row.*", *(F.col(c).alias(free_name(docs, c)) for c in added))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix),
]

#: The toxicity stage scores by a trained model, which SQL can't state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
