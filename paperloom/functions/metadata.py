"""Document metadata: frontmatter, header pairs and bold labels, inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import blocks as B
from . import constants as K
from . import lexer as L
from .runs import inline_runs
from .text import group, let, lookup, rstrip, strip, sub

PAIRS = "array<struct<key:string,value:string>>"
# unindented ``several words: value`` lines are entries too
WIDE_PAIR = r"(?Ud)^[^\s:#'\-\[\]{},&*!|>%@`][^:]*:(?:\s.*)?$"


def no_pairs() -> Column:
    return F.array().cast(PAIRS)


def _keys_before(entries: Column, i: Column) -> Column:
    return F.slice(entries, F.lit(1), i)


def last_wins(entries: Column) -> Column:
    """One entry per key: first position, last value."""
    return let(
        entries,
        lambda e: F.transform(
            first_wins(e),
            lambda x: F.struct(
                x["key"].alias("key"),
                F.element_at(F.filter(e, lambda y: y["key"] == x["key"]), -1)["value"].alias("value"),
            ),
        ),
    )


def first_wins(entries: Column) -> Column:
    return let(
        entries,
        lambda e: F.filter(e, lambda x, i: ~F.exists(_keys_before(e, i), lambda y: y["key"] == x["key"])),
    )


def value_of(entries: Column, key: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"]


def frontmatter_pairs(lines: Column) -> Column:
    """``key: value`` entries of a valid metadata block in line order, duplicates kept."""
    body = let(
        L.frontmatter_length(lines),
        lambda n: F.slice(lines, F.lit(2), F.greatest(n - 2, F.lit(0))),
    )
    kept = F.filter(
        F.transform(body, rstrip), lambda s: strip(s).rlike(K.FRONTMATTER_PAIR) | s.rlike(WIDE_PAIR)
    )

    def entry(s: Column) -> Column:
        value = strip(F.regexp_replace(s, F.lit("^[^:]*:"), F.lit("")))
        return F.struct(
            F.lower(F.btrim(strip(F.substring_index(s, ":", 1)), F.lit("\"'"))).alias("key"),
            F.when(
                value.rlike(r'^".*"$') & F.contains(value, F.lit("\\")),
                sub(F.substring(value, F.lit(2), F.length(value) - 2), r'\\(["\\])', "$1"),
            )
            .otherwise(F.btrim(F.btrim(value, F.lit('"')), F.lit("'")))
            .alias("value"),
        )

    return F.transform(kept, entry)


def header(spans: Column) -> Column:
    """Leading H1 / H2 / bold-pair blocks of a document without frontmatter.

    ``struct<n, title_pos, subtitle_pos, title, subtitle, pairs>``; positions are
    block indices, ``-1`` when absent.
    """
    codes = F.array_join(F.transform(spans, lambda b: b["code"]), "")
    candidates = F.slice(spans, F.lit(1), F.length(group(codes, "^[12P]*", 0)))

    def entry(b: Column) -> Column:
        pair = B.bold_pair(strip(B.paragraph_text(b["lines"])))
        return F.struct(
            b["code"].alias("code"), b["lines"].alias("lines"), F.when(b["code"] == "P", pair).alias("pair")
        )

    def region(c: Column) -> Column:
        kinds = F.array_join(
            F.transform(
                c, lambda e: F.when(e["code"] != "P", e["code"]).when(e["pair"].isNotNull(), F.lit("K")).otherwise(F.lit("P"))
            ),
            "",
        )
        return let(
            group(kinds, "^[12K]*", 0),
            lambda k: let(
                F.struct(
                    (F.instr(k, "1") - 1).alias("t"),
                    (F.instr(sub(k, "^[2K]*1", ""), "2") - 1).alias("rest"),
                    F.length(group(k, "^[2K]*1", 0)).alias("skip"),
                ),
                lambda p: _header_parts(c, k, p),
            ),
        )

    return let(F.transform(candidates, entry), region)


def _header_parts(c: Column, kinds: Column, p: Column) -> Column:
    title_pos = p["t"]
    subtitle_pos = F.when((title_pos >= 0) & (p["rest"] >= 0), p["skip"] + p["rest"]).otherwise(F.lit(-1))

    def heading(pos: Column) -> Column:
        return F.when(pos >= 0, let(F.get(c, pos), lambda e: B.heading_text(e["code"], e["lines"])))

    pairs = F.transform(
        F.filter(F.slice(c, F.lit(1), F.length(kinds)), lambda e: e["code"] == "P"), lambda e: e["pair"]
    )
    return F.struct(
        F.length(kinds).alias("n"),
        title_pos.alias("title_pos"),
        subtitle_pos.alias("subtitle_pos"),
        heading(title_pos).alias("title"),
        heading(subtitle_pos).alias("subtitle"),
        pairs.alias("pairs"),
    )


NO_HEADER = (
    "struct<n:int,title_pos:int,subtitle_pos:int,title:string,subtitle:string,"
    "pairs:array<struct<key:string,value:string>>>"
)


def document(text: Column, strict: bool = False) -> Column:
    """``struct<has_frontmatter, frontmatter, spans, header>`` of a text."""

    def build(lines: Column) -> Column:
        return let(
            F.struct(
                (L.frontmatter_length(lines) > 0).alias("fm"),
                L.block_spans(text, strict).alias("spans"),
            ),
            lambda d: F.struct(
                d["fm"].alias("has_frontmatter"),
                F.when(d["fm"], frontmatter_pairs(lines)).otherwise(no_pairs()).alias("frontmatter"),
                d["spans"].alias("spans"),
                F.when(~d["fm"], header(d["spans"]))
                .otherwise(
                    F.struct(
                        F.lit(0).alias("n"), F.lit(-1).alias("title_pos"), F.lit(-1).alias("subtitle_pos"),
                        F.lit(None).cast("string").alias("title"),
                        F.lit(None).cast("string").alias("subtitle"), no_pairs().alias("pairs"),
                    ).cast(NO_HEADER)
                )
                .alias("header"),
            ),
        )

    return let(L.split_lines(text), build)


def in_body(h: Column, idx: Column, code: Column) -> Column:
    """False for the header blocks that became metadata."""
    return ~(
        (idx < h["n"]) & ((code == "P") | (idx == h["title_pos"]) | (idx == h["subtitle_pos"]))
    )


def body_spans(doc: Column) -> Column:
    """Blocks left after header extraction, each with its ``block_idx``."""
    h = doc["header"]
    numbered = F.transform(
        doc["spans"],
        lambda b, i: F.struct(
            i.cast("int").alias("block_idx"), b["code"].alias("code"), b["start_line"].alias("start_line"),
            b["n_lines"].alias("n_lines"), b["lines"].alias("lines"),
        ),
    )
    return F.filter(numbered, lambda b: in_body(h, b["block_idx"], b["code"]))


def parsed_metadata(doc: Column) -> Column:
    """Fixed fields plus ``extra`` entries, before bold labels are looked at."""

    def from_frontmatter(m: Column) -> Column:
        fields = [
            F.coalesce(value_of(m, name), F.lit(default)).alias(name)
            for name, default in K.METADATA_DEFAULTS.items()
        ]
        extra = F.filter(m, lambda e: ~e["key"].isin(*K.METADATA_DEFAULTS))
        return F.struct(*fields, extra.alias("extra"))

    h = doc["header"]
    d = K.METADATA_DEFAULTS
    from_header = F.struct(
        F.coalesce(h["title"], F.lit(d["title"])).alias("title"),
        F.coalesce(h["subtitle"], F.lit(d["subtitle"])).alias("subtitle"),
        F.lit("").alias("company"),
        F.lit(d["ticker"]).alias("ticker"),
        F.lit(d["sector"]).alias("sector"),
        F.lit(d["analyst"]).alias("analyst"),
        last_wins(h["pairs"]).alias("extra"),
    )
    return F.when(
        doc["has_frontmatter"], let(last_wins(doc["frontmatter"]), from_frontmatter)
    ).otherwise(from_header)


def leading_label(text: Column) -> Column:
    """``struct<key, value>`` when a paragraph opens with a bold label, null otherwise."""

    def pair(runs: Column) -> Column:
        head = F.get(runs, F.lit(0))
        rest = strip(
            F.array_join(
                F.transform(F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0))), lambda r: r["text"]), ""
            )
        )
        label = strip(F.rtrim(F.rtrim(strip(head["text"]), F.lit(":")), F.lit("：")))
        inner = (rest == "") & F.contains(head["text"], F.lit(":"))
        inner_label = strip(F.rtrim(strip(F.substring_index(head["text"], ":", 1)), F.lit("：")))
        inner_value = strip(F.regexp_replace(head["text"], F.lit("(?s)^[^:]*:"), F.lit("")))
        key = F.when(inner, inner_label).otherwise(label)
        value = F.when(inner, inner_value).otherwise(rest)
        return F.when(
            head["bold"] & (label != "") & (value != ""), F.struct(key.alias("key"), value.alias("value"))
        )

    return F.when(text.rlike(r"^(?:\*\*|\\\*|<)"), let(inline_runs(text), pair))


def label_candidates(doc: Column) -> Column:
    """Bold-label pairs of body paragraphs before the first remaining H2."""

    def before_h2(body: Column) -> Column:
        stop = F.array_position(F.transform(body, lambda b: b["code"]), "2").cast("int")
        head = F.when(stop > 0, F.slice(body, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(body)
        paragraphs = F.filter(
            head, lambda b: (b["code"] == "P") & B.first_line(b["lines"]).rlike(r"\*|<")
        )
        found = F.transform(paragraphs, lambda b: leading_label(B.paragraph_text(b["lines"])))
        return F.filter(found, lambda p: p.isNotNull())

    return let(body_spans(doc), before_h2)


def inferred_metadata(doc: Column) -> Column:
    """Metadata after bold labels and the first heading have filled the gaps."""

    def named(candidates: Column) -> Column:
        return F.filter(
            F.transform(
                candidates,
                lambda p: F.struct(lookup(F.lower(p["key"]), K.LABEL_FIELDS).alias("key"), p["value"].alias("value")),
            ),
            lambda p: p["key"].isNotNull(),
        )

    keep = ["", *[v for v in K.METADATA_DEFAULTS.values() if v]]

    def field(m: Column, c: Column, name: str) -> Column:
        mine = F.filter(c, lambda p: p["key"] == name)
        settled = F.filter(mine, lambda p: ~p["value"].isin(*keep))
        return F.when(
            m[name].isin(*keep),
            F.coalesce(
                F.get(settled, F.lit(0))["value"],
                F.try_element_at(mine, F.lit(-1))["value"],
                m[name],
            ),
        ).otherwise(m[name])

    def merge(s: Column) -> Column:
        m, c, doc_ = s["m"], s["c"], s["doc"]
        h1 = F.filter(
            F.transform(
                F.filter(body_spans(doc_), lambda b: b["code"] == "1"),
                lambda b: strip(B.heading_text(b["code"], b["lines"])),
            ),
            lambda t: t != "",
        )
        extra = F.filter(c, lambda p: p["key"].isin("date", "analysis_period", "analysis_basis", "recipient"))
        return F.struct(
            F.when(
                m["title"] == K.METADATA_DEFAULTS["title"], F.coalesce(F.get(h1, F.lit(0)), m["title"])
            ).otherwise(m["title"]).alias("title"),
            m["subtitle"].alias("subtitle"),
            field(m, c, "company").alias("company"),
            m["ticker"].alias("ticker"),
            field(m, c, "sector").alias("sector"),
            field(m, c, "analyst").alias("analyst"),
            first_wins(F.concat(m["extra"], extra)).alias("extra"),
        )

    return let(
        doc,
        lambda d: let(
            F.struct(
                parsed_metadata(d).alias("m"), named(label_candidates(d)).alias("c"), d.alias("doc")
            ),
            merge,
        ),
    )


def subject_from_title(title: Column) -> Column:
    """Company or subject name a report title starts with."""
    options = []
    for d in K.SUBJECT_DELIMITERS:
        head = strip(F.substring_index(title, d, 1))
        options.append(F.when(F.contains(title, F.lit(d)) & (head != ""), head))
    for p in K.REPORT_SUFFIXES:
        head = strip(sub(title, "(?U)" + p))
        options.append(F.when((head != "") & (head != title), head))
    return F.when((title == "") | (title == K.METADATA_DEFAULTS["title"]), F.lit("")).otherwise(
        F.coalesce(*options, F.lit(""))
    )


def is_meaningful(value: Column, default: Column) -> Column:
    v = strip(F.coalesce(value, F.lit("")))
    return (v != "") & ((default == "") | (v != default)) & ~F.upper(v).isin(*K.PLACEHOLDER_VALUES)


def frontmatter_payload(m: Column) -> Column:
    """Entries worth writing: changed fixed fields, then ``extra`` in order."""
    fixed = F.array(
        *[
            F.when(
                (m[name] != "") & (m[name] != default),
                F.struct(F.lit(name).alias("key"), m[name].alias("value")),
            )
            for name, default in K.METADATA_DEFAULTS.items()
        ]
    )
    return F.concat(F.filter(fixed, lambda e: e.isNotNull()), m["extra"])


def quote_scalar(value: Column) -> Column:
    v = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(v, F.lit("\n"), F.lit("\\n")), F.lit('"'))


def frontmatter_text(m: Column) -> Column:
    """Metadata block between rules; empty when there is nothing to say."""
    lines = F.transform(
        frontmatter_payload(m), lambda e: F.concat(e["key"], F.lit(": "), quote_scalar(e["value"]))
    )
    return let(
        lines,
        lambda x: F.when(
            F.size(x) > 0, F.concat(F.lit("---\n"), F.array_join(x, "\n"), F.lit("\n---\n"))
        ).otherwise(F.lit("")),
    )
