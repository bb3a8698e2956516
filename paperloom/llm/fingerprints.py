"""Document fingerprints: SimHash with weighted terms, and permuted block tables to search them.

The terms of a text are its runs of ``TERM_WORDS`` consecutive words (ASCII letters lower-cased; a shorter text is one
term). Every occurrence votes with its length in characters on each of the 128 bits of the term's MD5: for the bit where
the hash has a one, against it where it has a zero. The fingerprint has the bits that won more than half of the weight.
The angle between two fingerprints estimates the angle between the term vectors: ``likeness`` is its cosine, 0 at least.

Votes are counted two bits to a number (32 bits each), so that 64 sums per text count all 128; the explosion of terms and
the sums stay in the stage that has the text, and only sums are ever shuffled, if at all. Texts together with their
successors in descending order of ids (``edited_fingerprints``) are joined by 128-bit keys; one exchange of the texts
serves both sides.

Search: fingerprints are cut into ``blocks`` blocks. Two that differ in at most ``radius`` bits agree in at least
``blocks - radius`` of them, so a table for each choice of that many blocks, keyed by these blocks (the permuted
fingerprint's head), finds them all. Equal fingerprints are one entry with a count. A pair is kept only in the first of
the tables that it meets in, so nothing has to be made distinct afterwards.

Defined cases: null texts are empty; a text without words has the fingerprint of all zeros; ids may be null (last in
descending order) or repeat: the successor of a row is the next of the distinct rows of id and text, by id, then by hash;
a table of one such row is followed by itself; an empty table gives an empty result. Texts up to 700 million characters
can be counted. The user's other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ordering import in_order, with_next

TERM_WORDS, BITS = 3, 128
#: Search: fingerprints of 128 bits within this many bits, by tables over pairs of 8 blocks (28 tables, keys of 32 bits).
RADIUS, BLOCKS = 6, 8
SEPARATORS = r"[\x20\x09-\x0D]+"
_PIECES, _HALF = 4, 16


def normal_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def fingerprints(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and ``fingerprint`` (32 hex digits), one row per distinct keys; rows of the same keys vote together."""
    words = rows.select(*keys, normal_words(F.col(text_col)).alias("_w"))
    ahead = [F.slice("_w", k + 1, F.greatest(F.size("_w") - k, F.lit(0))).alias(f"_{k}") for k in range(TERM_WORDS)]
    each = words.select(*keys, F.posexplode_outer(F.arrays_zip(*ahead)).alias("_at", "_t"))
    # the last places have no whole term; the first one stands for a text that is shorter
    each = each.filter(F.col(f"_t._{TERM_WORDS - 1}").isNotNull() | F.coalesce(F.col("_at") == 0, F.lit(True)))
    term = F.concat_ws(" ", *(F.col(f"_t._{k}") for k in range(TERM_WORDS)))
    hashed = each.select(*keys, term.alias("_term")).select(*keys, F.length("_term").cast("long").alias("_weight"), F.md5(F.col("_term").cast("binary")).alias("_h"))
    piece = lambda p: F.conv(F.substring("_h", 8 * p + 1, 8), 16, 10).cast("long")
    cut = hashed.select(*keys, "_weight", *(piece(p).alias(f"_x{p}") for p in range(_PIECES)))
    low = F.lit((1 << _HALF) - 1)
    spread = lambda x: x.bitwiseAND(low).bitwiseOR(F.shiftleft(F.shiftright(x, _HALF), 32))
    lanes = cut.select(*keys, "_weight", *(spread(F.col(f"_x{p}")).alias(f"_y{p}") for p in range(_PIECES)))
    both = F.lit((1 << 32) | 1)
    votes = [
        F.sum(F.col("_weight") * F.shiftright(F.col(f"_y{p}"), k).bitwiseAND(both)).alias(f"_{p}_{k}")
        for p in range(_PIECES) for k in range(_HALF)
    ]
    counted = lanes.groupBy(*keys).agg(F.sum("_weight").alias("_all"), *votes)

    def digits(p: int) -> Column:
        bits = []
        for k in range(_HALF):
            pair = F.col(f"_{p}_{k}")
            for votes_for, bit in ((pair.bitwiseAND(F.lit((1 << 32) - 1)), k), (F.shiftrightunsigned(pair, 32), k + _HALF)):
                bits.append(F.when(2 * votes_for > F.col("_all"), F.lit(1 << bit)).otherwise(F.lit(0).cast("long")))
        return F.lpad(F.lower(F.hex(sum(bits[1:], bits[0]))), 8, "0")

    return counted.select(*keys, F.concat(*(digits(p) for p in range(_PIECES))).alias("fingerprint"))


def _parts(fingerprint: Column) -> list[Column]:
    return [F.conv(F.substring(fingerprint, 8 * p + 1, 8), 16, 10).cast("long") for p in range(_PIECES)]


def distance(a: Column, b: Column) -> Column:
    """In how many bits two fingerprints differ."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_parts(a), _parts(b), strict=True)), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """The cosine of the angle that the distance stands for, from 0 to 1."""
    return F.round(F.greatest(F.lit(0.0), F.cos(F.lit(math.pi / BITS) * distance(a, b))), 6)


def _blocks(fingerprint: Column, blocks: int) -> list[Column]:
    digits = BITS // 4
    bounds = [digits * k // blocks for k in range(blocks + 1)]
    return [F.substring(fingerprint, a + 1, b - a) for a, b in itertools.pairwise(bounds)]


def block_tables(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """A row per fingerprint and table: ``table`` (the chosen blocks) and ``head``, their values, beside all columns."""
    if not 0 <= radius < blocks <= BITS // 4:
        raise ValueError("blocks must be more than radius, and 32 at most")
    chosen = list(itertools.combinations(range(blocks), blocks - radius))
    cut = fingerprints.withColumn("_blocks", F.array(*_blocks(F.col("fingerprint"), blocks)))
    tables = F.array(*(
        F.struct(F.lit(t).alias("table"), F.concat(*(F.get("_blocks", F.lit(k)) for k in of)).alias("head")) for t, of in enumerate(chosen)
    ))
    return cut.select(*fingerprints.columns, F.inline(tables))


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(fingerprint, near, bits)``: each distinct fingerprint of ``queries`` with all distinct ones of ``index`` within
    ``radius`` bits, itself included."""
    one = block_tables(queries.select("fingerprint").distinct(), radius, blocks)
    other = block_tables(index.select("fingerprint").distinct(), radius, blocks).withColumnRenamed("fingerprint", "near")
    # no broadcast: estimates don't know that a fingerprint has a row in every table
    met = one.join(other.hint("merge"), ["table", "head"]).withColumn("bits", distance(F.col("fingerprint"), F.col("near"))).filter(F.col("bits") <= radius)
    # the first table that both meet in: the first blocks that agree
    pairs = zip(_blocks(F.col("fingerprint"), blocks), _blocks(F.col("near"), blocks), strict=True)
    agree = F.filter(F.array(*(F.when(a == b, F.lit(k)) for k, (a, b) in enumerate(pairs))), lambda k: k.isNotNull())
    chosen = itertools.combinations(range(blocks), blocks - radius)
    number = F.create_map(*(x for t, of in enumerate(chosen) for x in (F.lit(",".join(map(str, of))), F.lit(t))))
    first = F.array_join(F.slice(agree, 1, blocks - radius).cast("array<string>"), ",")
    return met.filter(F.element_at(number, first) == F.col("table")).select("fingerprint", "near", "bits")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per distinct id and text: ``id, n_rows, n_chars, edited_sha256, fingerprint, edited_fingerprint`` and the key
    ``(k1, k2)`` of it and ``(next_k1, next_k2)`` of the row that follows in descending order of ids.

    The edited text has the last third of the characters replaced by as many from the start of the next row's text.
    """
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    rows = docs.select(own.alias("id"), text.alias("text"), F.xxhash64(own, text).alias("k1"), F.xxhash64(text, own, F.lit(1)).alias("k2"))
    sizes = rows.groupBy("k1", "k2", "id").agg(F.first(F.length("text")).alias("n_chars"), F.count("*").alias("n_rows"))
    placed = with_next(in_order(stored(sizes, "keys"), F.col("id").desc_nulls_last(), F.col("k1"), F.col("k2")))
    following = placed.select(F.col("at").alias("next_at"), F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"))
    # written, so that the plan that follows reads small tables
    links = stored(placed.join(following, "next_at").drop("at", "next_at"), "links")

    whole = rows.groupBy("k1", "k2").agg(F.first("text").alias("text"))  # shuffled once, read by both joins
    wanted = links.select(F.col("k1").alias("of_k1"), F.col("k2").alias("of_k2"), F.col("next_k1").alias("k1"), F.col("next_k2").alias("k2"), "n_chars")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    heads = whole.join(wanted, ["k1", "k2"]).select(F.col("of_k1").alias("k1"), F.col("of_k2").alias("k2"), F.substring(F.col("text"), F.lit(1), third).alias("head"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - third), F.col("head"))
    both = whole.join(heads, ["k1", "k2"]).join(links, ["k1", "k2"])
    both = both.select("id", "n_rows", "n_chars", "k1", "k2", "next_k1", "next_k2", "text", edited.alias("edited"))
    keys = ["k1", "k2", "id", "n_rows", "n_chars", "next_k1", "next_k2", "edited_sha256"]
    texts = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    kinds = [F.struct(F.lit(kind).alias("kind"), F.col(c).alias("text")) for kind, c in enumerate(("text", "edited"))]
    each = texts.select(*keys, F.explode(F.array(*kinds)).alias("x"))
    found = fingerprints(each.select(*keys, "x.kind", "x.text"), [*keys, "kind"])
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("fingerprint")))
    return stored(found.groupBy(*keys).agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint")), "fingerprints")
