"""Summaries of a corpus and comparison of two versions of it.

The texts of two versions meet in a single full outer join on ``doc_id``. Where
they differ, each is reduced to a record by a narrow expression, and every
difference is computed from that row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import audit as A
from ..functions import exprs as E
from ..functions.text import let, normalize_block, normalize_inline
from ..options import ParseOptions, RenderOptions
from .render import parsed_documents, roundtrip_corpus
from .structure import explode_rows

OPCODES = T.ArrayType(
    T.StructType(
        [T.StructField("tag", T.StringType())]
        + [T.StructField(n, T.IntegerType()) for n in ("i1", "i2", "j1", "j2")]
    )
)


def normalize_compare_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    t = F.col("text")
    return rows.select(*keys, normalize_inline(t).alias("inline_text"), normalize_block(t).alias("block_text"))


def block_summary(spans: DataFrame) -> DataFrame:
    """Canonical row per block ``(doc_id, block_idx, …)``."""
    out = spans.select("doc_id", "block_idx", E.block_summary().alias("s"))
    return out.select("doc_id", "block_idx", "s.*")


def block_counts(spans: DataFrame) -> DataFrame:
    """Blocks per document and type; counted on the map side first."""
    return spans.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def records(corpus: DataFrame) -> DataFrame:
    """``(doc_id, r)``: everything a comparison needs, one struct per document.

    Parse and summaries are two steps: in one expression their lambdas nest deeper than the analyzer resolves.
    """
    parsed = corpus.select("doc_id", F.explode_outer(F.array(E.record_source())).alias("r"))
    return parsed.select("doc_id", F.explode_outer(F.array(E.summarised_record())).alias("r"))


def document_summary(corpus: DataFrame) -> DataFrame:
    """Counts, headings and main metadata, one row per document."""
    b = F.col("r.blocks")
    heads = F.transform(F.filter(b, lambda x: x["level"].isNotNull()), lambda x: x["text"])

    def typed(name: str) -> Column:
        return F.size(F.filter(b, lambda x: x["type"] == name))

    return records(corpus).select(
        "doc_id", "r.title", "r.subtitle", "r.company",
        F.size(b).alias("block_count"),
        F.array_join(heads, " | ").alias("headings"),
        F.col("r.footnote_count").alias("footnote_count"),
        typed("IMAGE").alias("image_count"),
        typed("TABLE").alias("table_count"),
    )


def pair_versions(source: DataFrame, target: DataFrame, parts: str = "all") -> DataFrame:
    """``(doc_id, a, b)``: the records of both versions side by side, both null for documents with equal texts.

    The texts meet first; only those that differ are parsed. ``parts`` names what is asked of the pairs, so that nothing
    else is computed: "metadata" (``metadata_diff``), "counts" (``count_delta``), "status" (``audit_status``) or "all".
    """
    a = source.select("doc_id", F.col("text").alias("text_a"))
    b = target.select("doc_id", F.col("text").alias("text_b"))
    joined = a.join(b, "doc_id", "full_outer")
    # a generated row is evaluated once, whatever is asked of it later
    parsed = joined.select("doc_id", F.explode_outer(F.array(E.record_pair(parts))).alias("r"))
    cut = parsed.select("doc_id", "r", F.explode_outer(F.array(E.equal_ends())).alias("c"))
    once = cut.select("doc_id", F.explode_outer(F.array(E.summarised_pair(parts))).alias("r"))
    return once.select("doc_id", F.col("r.a").alias("a"), F.col("r.b").alias("b"))


def _entries(r: str, scope: str) -> Column:
    if scope == "extra":
        return F.coalesce(F.col(f"{r}.extra"), F.array().cast("array<struct<key:string,value:string>>"))
    return F.filter(
        F.array(
            *[
                F.struct(F.lit(f).alias("key"), F.col(f"{r}.{f}").alias("value"))
                for f in ("title", "subtitle", "company")
            ]
        ),
        lambda e: e["value"].isNotNull(),
    )


@E.per_application
def metadata_changes(scope: str) -> Column:
    """Keys of either side whose values differ, in key order."""

    def value(entries: Column, key: Column) -> Column:
        return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"]

    def diff(x: Column) -> Column:
        keys = F.array_sort(
            F.array_union(F.transform(x["a"], lambda e: e["key"]), F.transform(x["b"], lambda e: e["key"]))
        )
        rows = F.transform(
            keys,
            lambda k: F.struct(
                F.lit(scope).alias("scope"), k.alias("key"),
                value(x["a"], k).alias("source"), value(x["b"], k).alias("target"),
            ),
        )
        return F.filter(rows, lambda r: ~r["source"].eqNullSafe(r["target"]))

    return let(F.struct(_entries("a", scope).alias("a"), _entries("b", scope).alias("b")), diff)


def metadata_diff(pairs: DataFrame) -> DataFrame:
    """``(doc_id, scope, key, source, target)``."""
    rows = F.concat(metadata_changes("field"), metadata_changes("extra"))
    out = explode_rows(pairs, ["doc_id"], rows, "p", "c")
    return out.select("doc_id", "c.scope", "c.key", "c.source", "c.target")


def _blocks(side: str) -> Column:
    return F.coalesce(F.col(f"{side}.blocks"), F.array())


@E.per_application
def count_changes() -> Column:
    """``array<struct<name, delta>>``: block types, then notes, images, tables."""

    def of(entries: Column, name: Column) -> Column:
        return F.coalesce(F.get(F.filter(entries, lambda e: e["type"] == name), F.lit(0))["n"], F.lit(0))

    def diff(x: Column) -> Column:
        names = F.array_sort(
            F.array_union(F.transform(x["a"], lambda e: e["type"]), F.transform(x["b"], lambda e: e["type"]))
        )
        types = F.transform(
            names, lambda n: F.struct(n.alias("name"), (of(x["b"], n) - of(x["a"], n)).alias("delta"))
        )
        notes = F.coalesce(F.col("b.footnote_count"), F.lit(0)) - F.coalesce(F.col("a.footnote_count"), F.lit(0))
        more = F.array(
            F.struct(F.lit("footnote_count").alias("name"), notes.alias("delta")),
            *[
                F.struct(
                    F.lit(f"{t.lower()}_count").alias("name"),
                    (of(x["b"], F.lit(t)) - of(x["a"], F.lit(t))).alias("delta"),
                )
                for t in ("IMAGE", "TABLE")
            ],
        )
        return F.filter(F.concat(types, more), lambda c: c["delta"] != 0)

    return let(
        F.struct(
            let(_blocks("a"), A.type_counts).alias("a"), let(_blocks("b"), A.type_counts).alias("b")
        ),
        diff,
    )


def count_delta(pairs: DataFrame) -> DataFrame:
    out = explode_rows(pairs, ["doc_id"], count_changes(), "p", "c")
    return out.select("doc_id", "c.name", "c.delta")


@F.pandas_udf(OPCODES)
def _align(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edit steps between two key sequences; only documents that differ get here."""
    from difflib import SequenceMatcher

    for left, right in batches:
        yield pd.Series(
            [
                [
                    dict(zip(("tag", "i1", "i2", "j1", "j2"), op))
                    for op in SequenceMatcher(a=list(x), b=list(y), autojunk=False).get_opcodes()
                    if op[0] != "equal"
                ]
                for x, y in zip(left, right)
            ]
        )


def equal_head(x: Column, y: Column) -> Column:
    """Length of the equal start, 0 where a block occurs twice (then it matters to which one others are aligned)."""
    unique = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
    return F.when(unique, A.equal_run(x, y)).otherwise(0)


def equal_tail(x: Column, y: Column, head: Column) -> Column:
    unique = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
    most = F.least(F.size(x), F.size(y)) - head
    return F.when(unique, F.least(most, A.equal_run(F.reverse(x), F.reverse(y)))).otherwise(0)


def _changed_fields(s: Column, t: Column) -> Column:
    names = F.array(*[F.when(~s[f].eqNullSafe(t[f]), F.lit(f)) for f in A.SUMMARY_FIELDS])
    return F.filter(names, lambda n: n.isNotNull())


def _keyed(pairs: DataFrame) -> DataFrame:
    """Pairs with the hashes of their blocks."""
    keys = lambda side: F.transform(_blocks(side), lambda x: F.xxhash64(x))
    return pairs.select("doc_id", "a", "b", keys("a").alias("ka"), keys("b").alias("kb"))


def _with_changes(keyed: DataFrame) -> DataFrame:
    """``(doc_id, a, b, changes)``: the changed blocks of every pair in one array, empty where all blocks are equal."""
    cut = keyed.withColumn("head", equal_head(F.col("ka"), F.col("kb"))).withColumn("tail", equal_tail(F.col("ka"), F.col("kb"), F.col("head")))
    middle = lambda k: F.when(
        F.col("ka") != F.col("kb"), F.slice(k, F.col("head") + 1, F.size(k) - F.col("head") - F.col("tail"))
    ).otherwise(F.array().cast("array<bigint>"))
    found = cut.select("doc_id", "a", "b", "head", _align(middle("ka"), middle("kb")).alias("ops"))
    shifted = F.transform(
        "ops",
        lambda op: F.struct(op["tag"].alias("tag"), *((op[n] + F.col("head")).alias(n) for n in ("i1", "i2", "j1", "j2"))),
    )
    steps = found.select("doc_id", "a", "b", shifted.alias("ops"))

    def rows(op: Column, a: Column, b: Column) -> Column:
        both = F.least(op["i2"] - op["i1"], op["j2"] - op["j1"])

        def pairwise(k: Column) -> Column:
            i, j = op["i1"] + k, op["j1"] + k
            has_s, has_t = i < op["i2"], j < op["j2"]
            return F.struct(
                F.when(has_s & has_t, F.lit("changed")).when(has_s, F.lit("removed")).otherwise(F.lit("added")).alias("change"),
                F.when(has_s, i + 1).alias("source_index"),
                F.when(has_t, j + 1).alias("target_index"),
                F.when(has_s, F.get(a, i)).alias("source"),
                F.when(has_t, F.get(b, j)).alias("target"),
            )

        n = F.greatest(op["i2"] - op["i1"], op["j2"] - op["j1"])
        return F.when(both >= 0, F.transform(F.sequence(F.lit(0), n - 1), pairwise))

    changes = let(
        F.struct(_blocks("a").alias("a"), _blocks("b").alias("b")),
        lambda s: F.flatten(F.transform(F.col("ops"), lambda op: rows(op, s["a"], s["b"]))),
    )
    return steps.select("doc_id", "a", "b", changes.alias("changes"))


def block_diff(pairs: DataFrame) -> DataFrame:
    """Changed, removed and added blocks with 1-based positions.

    Equal documents leave before the alignment. Blocks are compared by hash;
    where no block occurs twice, equal ends are cut off first, so the pandas
    function only sees the hashes between the first and the last difference.
    """
    changed = _with_changes(_keyed(pairs).filter(F.col("ka") != F.col("kb")))
    out = explode_rows(changed, ["doc_id"], F.col("changes"), "change_no", "c")
    fields = F.when(F.col("c.change") == "changed", _changed_fields(F.col("c.source"), F.col("c.target")))
    return out.select(
        "doc_id", "change_no", "c.change", "c.source_index", "c.target_index",
        F.coalesce(F.array_join(fields, ","), F.lit("")).alias("changed_fields"),
        "c.source", "c.target",
    )


@E.per_application
def is_changed() -> Column:
    """Does anything differ?  Equal blocks have equal counts, so counts need no test."""

    def differs(field: str) -> Column:
        return ~F.col(f"a.{field}").eqNullSafe(F.col(f"b.{field}"))

    plain = reduce(
        lambda x, y: x | y, [differs(f) for f in ("title", "subtitle", "company", "footnote_count", "blocks")]
    )
    # entries are compared key by key only where their lists are not the same
    return plain | (differs("extra") & (F.size(metadata_changes("extra")) > 0))


def audit_status(pairs: DataFrame) -> DataFrame:
    """PASS when nothing differs; no alignment needed for that."""
    return pairs.select("doc_id", F.when(is_changed(), F.lit("FAIL")).otherwise(F.lit("PASS")).alias("status"))


def audit_totals(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("documents"))


def preview(text: Column, limit: int = 80) -> Column:
    one = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.left(one, F.lit(limit - 3)), F.lit("...")))


def _shown(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("<missing>"))


def audit_report(pairs: DataFrame) -> DataFrame:
    """Readable report per document: ``(doc_id, report)``."""
    def line(c: Column) -> Column:
        fields = F.when(c["change"] == "changed", F.array_join(_changed_fields(c["source"], c["target"]), ",")).otherwise(F.lit(""))
        return F.concat(
            F.lit("  - "), c["change"], F.lit(": "),
            F.when(c["source_index"].isNotNull(), F.concat(F.lit("src#"), c["source_index"].cast("string"), F.lit(":"), c["source"]["type"])).otherwise(F.lit("src#<missing>")),
            F.lit(" -> "),
            F.when(c["target_index"].isNotNull(), F.concat(F.lit("rt#"), c["target_index"].cast("string"), F.lit(":"), c["target"]["type"])).otherwise(F.lit("rt#<missing>")),
            F.when(fields != "", F.concat(F.lit(" fields="), fields)).otherwise(F.lit("")),
            F.lit("\n    text: "),
            F.coalesce(preview(c["source"]["text"]), F.lit("<missing>")),
            F.lit(" -> "),
            F.coalesce(preview(c["target"]["text"]), F.lit("<missing>")),
        )

    def section(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(title + "\n"), F.array_join(items, "\n")))

    def values(scope: str) -> Column:
        return F.transform(
            metadata_changes(scope),
            lambda c: F.concat(F.lit("  - "), c["key"], F.lit(": "), _shown(c["source"]), F.lit(" -> "), _shown(c["target"])),
        )

    def totals(x: Column) -> Column:
        types = F.filter(x, lambda c: ~c["name"].endswith("_count"))

        def one(name: str, label: str) -> Column:
            d = F.get(F.filter(x, lambda c: c["name"] == name), F.lit(0))["delta"]
            return F.when(d.isNotNull(), F.concat(F.lit(f"{label} delta: "), F.format_string("%+d", d)))

        return F.array(
            F.when(
                F.size(types) > 0,
                F.concat(
                    F.lit("Element count deltas: {"),
                    F.array_join(
                        F.transform(types, lambda c: F.concat(F.lit("'"), c["name"], F.lit("': "), c["delta"].cast("string"))), ", "
                    ),
                    F.lit("}"),
                ),
            ),
            one("footnote_count", "Footnotes"), one("image_count", "Images"), one("table_count", "Tables"),
        )

    # pairs are parsed once: their changed blocks stay in the row
    head = _with_changes(_keyed(pairs)).select(
        "doc_id", "changes",
        F.when(is_changed(), F.lit("FAIL")).otherwise(F.lit("PASS")).alias("status"),
        F.concat(
            F.array(section("Metadata fields:", values("field")), section("Metadata extra:", values("extra"))),
            let(count_changes(), totals),
        ).alias("parts"),
    )
    body = F.filter(
        F.concat(
            F.array(F.concat(F.lit("Status: "), "status")),
            F.when(F.col("status") == "PASS", F.array(F.lit("No semantic differences detected."))).otherwise(F.col("parts")),
            F.array(section("Changed elements:", F.transform("changes", line))),
        ),
        lambda p: p.isNotNull(),
    )
    return head.select("doc_id", F.array_join(body, "\n").alias("report"))


def audit_json(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """The whole comparison as one JSON text per document: inputs, status, metadata, counts and changed elements."""
    element = lambda c: F.struct(
        c["change"].alias("change"), c["source_index"].alias("source_index"), c["target_index"].alias("target_index"),
        F.when(c["change"] == "changed", _changed_fields(c["source"], c["target"])).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        c["source"].alias("source"), c["target"].alias("target"),
    )
    # pairs are parsed once: their changed blocks stay in the row
    return _with_changes(_keyed(pairs)).select(
        "doc_id",
        F.to_json(
            F.struct(
                F.lit(source).alias("source"), F.lit(target).alias("target"),
                F.when(is_changed(), F.lit("FAIL")).otherwise(F.lit("PASS")).alias("status"),
                metadata_changes("field").alias("metadata_fields"), metadata_changes("extra").alias("metadata_extra"),
                count_changes().alias("counts"), F.transform("changes", element).alias("elements"),
            )
        ).alias("report"),
    )


def roundtrip_pairs(corpus: DataFrame, options: RenderOptions = RenderOptions()) -> DataFrame:
    """Source against its rendered and re-parsed form."""
    return pair_versions(corpus, roundtrip_corpus(corpus, options))


def roundtrip_stable(corpus: DataFrame, options: RenderOptions = RenderOptions()) -> DataFrame:
    """``(doc_id, blocks, status, changed)``: what one more pass changes in the blocks of each document.

    PASS when every type keeps its number of blocks; ``changed`` names the types of blocks that are not found again at
    their place. Both parsed texts of a document stay in its row, so each is parsed and rendered once and no block is shuffled.
    """
    once = parsed_documents(corpus)
    again = once.select("doc_id", F.col("d").alias("before"), F.explode_outer(F.array(E.markdown(options, ParseOptions()))).alias("text"))
    both = again.select("doc_id", "before", F.explode_outer(F.array(E.document())).alias("after"))
    told = both.select("doc_id", F.explode_outer(F.array(E.moved_blocks())).alias("m")).filter("m.told")
    return told.select(
        "doc_id",
        F.col("m.blocks").cast("long").alias("blocks"),
        F.when(F.col("m.same_types"), "PASS").otherwise("FAIL").alias("status"),
        F.array_join(F.array_sort(F.array_distinct("m.types")), ",").alias("changed"),
    )
