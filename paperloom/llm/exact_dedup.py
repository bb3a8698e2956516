"""Exact deduplication with a split at the heavy hitters.

One pass writes ``(id, digest)``. A Misra-Gries summary (Spark's ``freqItems``) names every digest that holds more than
``support`` of the rows; an exact count verifies them. The winners, ``1 / support`` rows at most, are broadcast and
their groups are decided on the map side. All other digests are small groups and take the ordinary shuffle.

Defined cases: a null text is an empty text; ids may be null (they sort below all others) or repeat; of rows equal in
id and text exactly one is kept; an empty table gives an empty result; other columns, whatever their names, are carried
along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, stored

#: Share of the rows from which a digest counts as frequent. At most 1 / SUPPORT digests are broadcast.
SUPPORT = 0.001


def text_digest(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


def frequent_digests(keyed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``(digest, n, keep_id, n_top)`` of the digests that hold more than ``support`` of the rows of ``(id, digest)``.

    ``n_top`` counts the rows that carry ``keep_id`` (more than one if rows repeat).
    """
    named = keyed.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    least = support * keyed.count()
    counted = (
        keyed.join(F.broadcast(named), "digest").groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("id").alias("keep_id"))
        .filter(F.col("n") > least)
    )
    counted = stored(counted, "frequent")
    top = (
        keyed.join(F.broadcast(counted.select(F.col("digest").alias("d"), "keep_id")), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest").agg(F.count("*").alias("n_top"))
    )
    return stored(counted.join(F.broadcast(top), "digest"), "winners")


def _by_digest() -> Window:
    return Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last())


def dedup_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: ``id, digest, keep_id, group_size, kept``."""
    keyed = stored(docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest")), "digests")
    winners = F.broadcast(frequent_digests(keyed, support))
    heavy = keyed.join(winners, "digest").filter(~F.col("id").eqNullSafe(F.col("keep_id")))
    top = winners.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_top"))))
    # the frame of a running window is the row itself and what went before: nothing is buffered but the counts
    light = keyed.join(winners, "digest", "left_anti").select(
        "id", "digest",
        F.first("id").over(_by_digest()).alias("keep_id"),
        F.count("*").over(Window.partitionBy("digest")).alias("group_size"),
        (F.row_number().over(_by_digest()) == 1).alias("kept"),
    )
    return (
        heavy.select("id", "digest", "keep_id", F.col("n").alias("group_size"), F.lit(False).alias("kept"))
        .unionByName(top.select(F.col("keep_id").alias("id"), "digest", "keep_id", F.col("n").alias("group_size"), (F.col("copy") == 1).alias("kept")))
        .unionByName(light)
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the row with the largest id."""
    rows = packed(docs, id=F.col(id_col), digest=text_digest(text_col))
    keyed = stored(docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest")), "digests")
    winners = frequent_digests(keyed, support)
    kept_id = F.broadcast(winners.select(F.col("digest").alias("d"), "keep_id"))
    heavy = (
        rows.join(kept_id, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest").agg(F.first("row").alias("row"))
    )
    light = (
        rows.join(F.broadcast(winners), "digest", "left_anti")
        .withColumn("nth", F.row_number().over(_by_digest())).filter("nth = 1")
    )
    return heavy.select("row.*").unionByName(light.select("row.*"))
