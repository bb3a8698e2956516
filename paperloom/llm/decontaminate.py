"""Benchmark decontamination by word n-grams.

The benchmark's windows (``n`` consecutive words; a shorter item is one window) form a hash set that is broadcast, if its
checked size allows, to a scan over all windows of all documents. Every hash hit is verified word by word. The result
says which words of which documents are hit by which items; documents or spans can then be removed. Everything is
DataFrame functions: the only shuffle before removal carries one small row per document and one per hit.

Defined cases: null and empty texts have no words and are never hit; null, empty and wordless items have no window; an
item with a null id hits but is not listed; ids may be null or repeat: the hits of a document are keyed by id and text,
so repeated rows agree; an empty table on either side gives clean documents or none; the user's other columns, whatever
their names, are carried along.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored

NGRAM = 10
#: Runs of ASCII characters that belong to no word: all but 0-9, a-z and what lies beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORIGINAL_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORIGINAL_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows, and bytes of their words and items, up to which the set is broadcast; beyond, windows are joined by a shuffle.
MAX_BROADCAST_WINDOWS, MAX_BROADCAST_BYTES = 200_000, 100_000_000


def normal_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, n: int = NGRAM, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(len, h, gram, items)``: every distinct window with its hash and the items that contain it."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), normal_words(F.col(text_col)).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("len", F.least(F.lit(n), F.size("words")))
    at = items.select("item", "words", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"))
    grams = at.select("item", "len", F.slice("words", F.col("at"), F.col("len")).alias("gram"))
    return grams.groupBy("len", "gram").agg(F.collect_set("item").alias("items")).select(
        "len", F.xxhash64(word_hashes(F.col("gram"))).alias("h"), "gram", "items"
    )


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS,
) -> DataFrame:
    """Per distinct id and text: ``id, text_hash, n_rows, n_words, hit`` (positions from 1) and ``items`` (as strings)."""
    windows = stored(benchmark_windows(benchmark, n, item_col, item_text_col), "windows")
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect()) or [n]  # at most n numbers
    side = windows.select(F.col("len").alias("gram_len"), F.col("h").alias("gram_h"), "gram", "items")
    length = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w))
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(length(F.col("gram")) + length(F.col("items"))), F.lit(0)).alias("bytes")).first()
    small = size["n"] <= max_broadcast and size["bytes"] <= MAX_BROADCAST_BYTES
    words = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        normal_words(F.col(text_col)).alias("words"),
    )
    hashed = words.withColumn("hashes", word_hashes(F.col("words")))
    if len(lengths) > 1:
        hashed = hashed.withColumn("len", F.explode(F.array(*map(F.lit, lengths))))
    else:
        hashed = hashed.withColumn("len", F.lit(lengths[0]))
    # position 0 stands for the document itself, so that documents without a hit stay
    first = F.when(F.col("len") == lengths[0], 0).otherwise(1)
    last = F.greatest(F.size("words") - F.col("len") + 1, first)
    scanned = hashed.select(
        "id", "text_hash", "words", "hashes", "len", F.explode_outer(F.sequence(first, last)).alias("at")
    ).filter((F.col("at") == 0) | (F.col("at") + F.col("len") <= F.size("words") + 1))
    scanned = scanned.withColumn("h", F.when(F.col("at") > 0, F.xxhash64(F.slice("hashes", F.greatest("at", F.lit(1)), F.col("len")))))
    if not small:
        found = _found_by_shuffle(scanned, words, side)
        return _per_document(found)
    joined = scanned.join(F.broadcast(side), (F.col("h") == F.col("gram_h")) & (F.col("len") == F.col("gram_len")), "left")
    verified = F.col("gram") == F.slice("words", F.greatest("at", F.lit(1)), F.col("len"))
    found = joined.filter((F.col("at") == 0) | (F.col("gram").isNotNull() & verified)).select(
        "id", "text_hash", F.size("words").alias("n_words"), "at", "items",
        F.when(F.col("at") > 0, F.sequence("at", F.col("at") + F.col("len") - 1)).alias("span"),
    )
    return _per_document(found)


def _found_by_shuffle(scanned: DataFrame, words: DataFrame, windows: DataFrame) -> DataFrame:
    """As the join with the broadcast set, for sets of any size.

    Only places and hashes of document windows are shuffled, against the distinct hashes of the set; the words of documents
    that are hit, one row each, are fetched afterwards to verify.
    """
    key = ["id", "text_hash"]
    places = scanned.filter("at > 0").select(*key, "at", "len", "h")
    hashes = windows.select(F.col("gram_len").alias("len"), F.col("gram_h").alias("h")).distinct()
    per_document = places.join(hashes, ["len", "h"], "left_semi").groupBy(*key).agg(F.collect_set(F.struct("at", "len", "h")).alias("places"))  # of one text
    of = per_document.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "places")
    same = (F.col("text_hash") == F.col("hit_hash")) & F.col("id").eqNullSafe(F.col("hit_id"))
    texts = words.join(of, same).groupBy(*key).agg(F.first("words").alias("words"), F.first("places").alias("places"))
    grams = texts.select(*key, F.size("words").alias("n_words"), "words", F.explode("places").alias("p")).select(
        *key, "n_words", "p.*", F.slice("words", F.col("p.at"), F.col("p.len")).alias("found")
    )
    hits = grams.join(windows, (F.col("h") == F.col("gram_h")) & (F.col("len") == F.col("gram_len"))).filter(F.col("found") == F.col("gram"))
    hits = hits.select(*key, "n_words", "at", "items", F.sequence("at", F.col("at") + F.col("len") - 1).alias("span"))
    every = words.select(*key, F.size("words").alias("n_words"), F.lit(0).alias("at"))
    return every.unionByName(hits, allowMissingColumns=True)


def _per_document(found: DataFrame) -> DataFrame:
    return found.groupBy("id", "text_hash").agg(
        F.sum((F.col("at") == 0).cast("long")).alias("n_rows"), F.max("n_words").cast("long").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("span"))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def without_words(text: Column, hit: Column) -> Column:
    """``text`` without the words at the positions ``hit`` and the separators that follow them."""
    words = F.array_remove(F.split(text, ORIGINAL_SEPARATORS), "")
    gaps = F.split(text, ORIGINAL_WORDS)
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(words)),
        lambda i: F.when(F.array_contains(hit, i), F.lit("")).otherwise(F.concat(F.element_at(words, i), F.element_at(gaps, i + 1))),
    )
    return F.concat(F.element_at(gaps, 1), F.array_join(pieces, ""))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = NGRAM, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words removed from their texts (``remove="spans"``)."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    hits = benchmark_hits(docs, benchmark, n, id_col, text_col, item_col, item_text_col).filter(F.size("hit") > 0)
    hits = hits.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "hit")
    rows = packed(docs, id=F.col(id_col), text_hash=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = (F.col("text_hash") == F.col("hit_hash")) & F.col("id").eqNullSafe(F.col("hit_id"))
    if remove == "documents":
        return rows.join(hits, same, "left_anti").select("row.*")
    text = F.col("row")[text_col]
    cleaned = F.when(F.col("hit").isNull(), text).otherwise(without_words(text, F.col("hit")))
    return rows.join(hits, same, "left").select(
        *(cleaned.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns)
    )
