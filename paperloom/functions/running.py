"""Running sums and maxima that never put a whole key into one task.

Rows of a key are cut into chunks by a range of the order column.  Windows run
inside chunks only; one small row per chunk carries the totals before it.  A
key with a third of all rows is then many chunks on many tasks, and only its
chunk totals (one row per ``chunk`` order values) meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add inclusive running sums and maxima of expressions, per key in order.

    Keys must not be null and ``order`` must be unique within a key.  Null values are skipped; a sum starts at
    0, a maximum is null until its first value.  The running *last value* is the
    maximum of ``struct(order, value)``.
    """
    sums, maxima = sums or {}, maxima or {}
    part = ["_key", "_chunk"]
    # dealt out before totals and windows branch off: both read this one shuffle, so the rows are made once; a struct is
    # never null, so the join adds no filter of keys that would make the two shuffles differ
    dealt = df.withColumns({"_key": F.struct(*keys), "_chunk": F.floor(F.col(order) / chunk)})
    rows = dealt.drop(*keys).repartition(*part)
    inputs = {**{n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}, **maxima}
    rows = rows.withColumns(inputs)

    totals = rows.groupBy(*part).agg(
        *[F.sum(n).alias(f"_{n}") for n in sums], *[F.max(n).alias(f"_{n}") for n in maxima]
    )
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *part,
        F.count(F.lit(1)).over(before).alias("_earlier"),
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums],
        *[F.max(f"_{n}").over(before).alias(f"_{n}") for n in maxima],
    )
    carried = carried.filter("_earlier > 0").drop("_earlier")  # a key's first chunk has nothing before it

    inside = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns(
        {**{n: F.sum(n).over(inside) for n in sums}, **{n: F.max(n).over(inside) for n in maxima}}
    )
    joined = local.join(carried, part, "left")
    done = {
        **{n: (F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in sums},
        **{n: F.greatest(F.col(n), F.col(f"_{n}")).alias(n) for n in maxima},
    }
    names = [*df.columns, *(n for n in inputs if n not in df.columns)]
    return joined.withColumns(done).select(*(F.col("_key")[n].alias(n) if n in keys else F.col(n) for n in names))
