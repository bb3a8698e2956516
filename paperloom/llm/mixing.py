"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target size over its own size. Each document draws its number of copies by
inverting the Poisson distribution of that mean at a uniform value hashed from seed and id, is exploded by that number,
and the copies are shuffled globally by a hash of seed, id and copy. Equal seeds give equal mixtures, whatever the
partitioning.

A mean above ``PIECE`` is a sum of that many independent Poisson pieces, each with a hash of its own, so that the
distribution never underflows.

Defined cases: a null source is a source of its own; a null id is replaced by the digest of the text; a null or empty
text has size 1; a source without a given weight gets ``other_weight`` (0 leaves it out, as asked for); repeated rows
draw the same count; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored

PIECE = 500.0
#: Up to so many sources (under 10 MB of rates and distributions for usual means) the rates are broadcast.
MAX_BROADCAST_SOURCES = 10_000
#: Exponent of the weights that are used if none are given: weight = size ** TEMPER.
TEMPER = 0.5


def hashed_uniform(*parts: Column | str) -> Column:
    """A uniform value in [0, 1) with 52 bits, from the MD5 of the parts joined by '|'."""
    return hashed_bits(*parts).cast("double") / F.lit(float(2**52))


def hashed_bits(*parts: Column | str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def text_size(text: str = "text") -> Column:
    return F.greatest(F.char_length(F.coalesce(F.col(text), F.lit(""))), F.lit(1)).cast("long")


def source_rates(
    docs: DataFrame, source_col: str = "source", size: Column | None = None, weights: Mapping[str, float] | None = None,
    other_weight: float = 0.0, epochs: float = 1.0,
) -> DataFrame:
    """``(source, size, rate, pieces, cdf)``: the mean repetition rate of every source and its distribution."""
    size = text_size() if size is None else size
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(TEMPER))
    else:
        weight = F.lit(float(other_weight))
        for name, value in sorted(weights.items()):
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    weighed = stored(sizes.withColumn("weight", weight), "sizes")
    total = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(float(total["weight"] or 1.0))
    rate = share * F.lit(float(epochs) * float(total["size"] or 0)) / F.col("size")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")
    mean = F.col("rate") / F.col("pieces")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + p).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]
    return weighed.withColumn("rate", rate).withColumn("pieces", pieces).withColumn("cdf", cdf)


def copies(key: Column, seed: str, pieces: Column, cdf: Column) -> Column:
    """The Poisson count of a document: per piece the smallest k whose cumulated probability exceeds the hash."""
    draw = lambda i: hashed_uniform(F.lit(seed), key, i.cast("string"))
    drawn = F.transform(F.sequence(F.lit(1), pieces), draw)
    return F.aggregate(drawn, F.lit(0), lambda n, u: n + F.size(F.filter(cdf, lambda c: c <= u)))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Mapping[str, float] | None = None, other_weight: float = 0.0, epochs: float = 1.0, seed: str = "mix-1",
) -> DataFrame:
    """The mixture: the rows of ``docs``, each as often as drawn, as ``row, copy, n_copies, shuffle_key``, shuffled.

    ``row`` is the whole row as a struct.
    """
    rates = stored(source_rates(docs, source_col, text_size(text_col), weights, other_weight, epochs), "rates")
    key = F.coalesce(F.col(id_col).cast("string"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = packed(docs, src=F.col(source_col), key=key)
    rates = rates.select("source", "pieces", "cdf")
    if rates.count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    # beyond the bound: an ordinary join, whose hot sources adaptive execution splits
    counted = rows.join(rates, F.col("src").eqNullSafe(F.col("source"))).select(
        "row", "key", copies(F.col("key"), seed, F.col("pieces"), F.col("cdf")).alias("n_copies")
    )
    copied = counted.filter("n_copies > 0").select(
        "row", "key", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy")
    )
    keyed = copied.select("row", "copy", "n_copies", hashed_bits(F.lit(seed), F.col("key"), F.lit("order"), F.col("copy").cast("string")).alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
