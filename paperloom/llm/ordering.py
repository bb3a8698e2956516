"""Global order of rows without one task for all of them, or for all rows of a key.

Rows are dealt by ranges of the order into as many parts as the session shuffles into, sorted there and numbered; the
numbers rise through all parts, so that what needs a global window elsewhere becomes joins on numbers and one small row
per part (and key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: The bits below are the place within a part, as monotonically_increasing_id() gives it.
PLACE_BITS = 33


def in_order(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``at``, a number that rises with the order; written once, so that it never changes."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(placed.withColumn("at", F.monotonically_increasing_id()), "ordered")


def part(at: Column | str = "at") -> Column:
    return F.shiftright(at, PLACE_BITS)


def with_next(ordered: DataFrame) -> DataFrame:
    """Rows of ``in_order`` with ``next_at``, the number of the row that follows; the first follows the last."""
    # one row per part: a number that the session sets, whatever the size of the table
    ends = ordered.groupBy(part().alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    by_part = Window.orderBy("part")
    ends = ends.select("last", F.lead("first").over(by_part).alias("following"), F.first("first").over(by_part).alias("least"))
    joined = ordered.join(ends, ordered["at"] == ends["last"], "left")
    follows = F.when(F.col("last").isNull(), F.col("at") + 1).otherwise(F.coalesce("following", "least"))
    return joined.withColumn("next_at", follows).drop("last", "following", "least")


def numbered(ordered: DataFrame, key: str) -> DataFrame:
    """Rows of ``in_order`` (by ``key`` first) with ``nth``, the row's number within its key from 1.

    A key with most of all rows lies in many parts; only its count per part meets in one place.
    """
    pieces = ordered.groupBy(part().alias("part"), F.col(key).alias("of")).agg(F.min("at").alias("from_at"), F.count("*").alias("n"))
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("part", "of", "from_at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    rows = ordered.withColumn("part", part())
    joined = rows.join(pieces, (rows["part"] == pieces["part"]) & rows[key].eqNullSafe(pieces["of"])).drop(pieces["part"])
    return joined.withColumn("nth", F.col("at") - F.col("from_at") + F.col("earlier") + 1).drop("part", "of", "from_at", "earlier")


def running_before(ordered: DataFrame, key: str, **aggregates: tuple) -> DataFrame:
    """Rows of ``in_order`` (by ``key`` first) with a combination of all earlier rows of their key, 0 where there is none.

    ``aggregates`` are ``name=(function, combine, column)``: an aggregate function, and how two of its results combine (as a
    sum or ``bit_xor``). Only one row per key and part meets the others of its key.
    """
    rows = ordered.withColumn("part", part())
    inside = Window.partitionBy("part", key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(f(c).over(inside), F.lit(0)) for n, (f, _, c) in aggregates.items()})
    pieces = ordered.groupBy(part().alias("part"), F.col(key).alias("of")).agg(*(f(c).alias(f"{n}_earlier") for n, (f, _, c) in aggregates.items()))
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = {f"{n}_earlier": F.coalesce(f(f"{n}_earlier").over(before), F.lit(0)) for n, (f, _, _) in aggregates.items()}
    pieces = pieces.withColumns(earlier)
    joined = rows.join(pieces, (rows["part"] == pieces["part"]) & rows[key].eqNullSafe(pieces["of"])).drop(pieces["part"])
    return joined.withColumns({n: combine(F.col(n), F.col(f"{n}_earlier")) for n, (_, combine, _) in aggregates.items()}).drop("part", "of", *earlier)
