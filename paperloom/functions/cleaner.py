"""Research markers (private-use characters) inside a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import CleanerOptions
from . import constants as K
from .text import cut, group, let, rstrip, strip, sub


def has_markers(text: Column) -> Column:
    return F.contains(text, F.lit(K.MARK_OPEN)) & text.rlike(K.MARKER)


def pieces(text: Column) -> Column:
    """``array<struct<pos, tag, payload, text>>``; ``tag`` is null for plain text."""
    return F.transform(
        cut(text, K.MARKER),
        lambda p, i: F.struct(
            i.alias("pos"),
            F.when(i % 2 == 1, F.lower(group(p, K.MARKER, 1))).alias("tag"),
            F.when(i % 2 == 1, group(p, K.MARKER, 2)).alias("payload"),
            p.alias("text"),
        ),
    )


def cite_sources(payload: Column) -> Column:
    """Trimmed source ids of a citation payload."""
    ids = F.filter(F.transform(F.split(payload, K.MARK_SEP, -1), strip), lambda x: x != "")
    return F.when((F.size(ids) == 0) & (strip(payload) != ""), F.array(strip(payload))).otherwise(ids)


def source_order(parts: Column) -> Column:
    """Distinct source ids of a document by first appearance; position = number."""
    cites = F.filter(parts, lambda p: p["tag"] == "cite")
    return F.array_distinct(F.flatten(F.transform(cites, lambda p: cite_sources(p["payload"]))))


def squeeze(text: Column) -> Column:
    return strip(sub(text, r"(?U)[\s\x1c-\x1f]+", " "))


def entity_text(payload: Column) -> Column:
    item = F.get_json_object(payload, "$[1]")
    shown = (
        F.when(item.isNull(), F.lit("None")).when(item == "true", F.lit("True"))
        .when(item == "false", F.lit("False")).otherwise(item)
    )
    return F.when(F.json_array_length(payload) >= 2, shown).otherwise(squeeze(payload))


def image_group_text(payload: Column) -> Column:
    def given(c: Column) -> Column:
        return F.when(~c.isin("", "[]", "{}", "0", "false"), c)

    chosen = F.coalesce(
        given(F.get_json_object(payload, "$.query")), given(F.get_json_object(payload, "$.queries"))
    )
    items = F.when(chosen.startswith("["), F.from_json(chosen, "array<string>"))
    return F.when(
        F.size(items) > 0,
        F.concat(F.lit("\n<!-- image_group: "), F.array_join(items, ", "), F.lit(" -->\n")),
    ).otherwise(F.lit("\n<!-- image_group removed -->\n"))


def unknown_text(tag: Column, payload: Column, drop: bool) -> Column:
    if drop:
        return F.lit("")
    compact = squeeze(payload)
    limit = K.UNKNOWN_PAYLOAD_LIMIT
    shown = F.when(F.length(compact) > limit, F.concat(F.left(compact, F.lit(limit)), F.lit("..."))).otherwise(compact)
    return F.concat(F.lit("<!-- "), tag, F.lit(": "), shown, F.lit(" -->"))


def cite_text(payload: Column, order: Column, mode: str) -> Column:
    if mode == "strip":
        return F.lit("")
    ids = cite_sources(payload)
    if mode == "inline":
        return let(
            ids,
            lambda x: F.when(
                F.size(x) > 0, F.concat(F.lit(" (sources: "), F.array_join(x, ", "), F.lit(")"))
            ).otherwise(F.lit("")),
        )
    return F.array_join(
        F.transform(
            ids, lambda x: F.concat(F.lit("[^"), F.array_position(order, x).cast("string"), F.lit("]"))
        ),
        "",
    )


def replaced(parts: Column, order: Column, options: CleanerOptions) -> Column:
    """Text with every marker replaced, private-use leftovers still inside."""

    def one(p: Column) -> Column:
        tag, payload = p["tag"], p["payload"]
        return (
            F.when(tag.isNull(), p["text"])
            .when(tag == "cite", cite_text(payload, order, options.cite_mode))
            .when(tag == "entity", entity_text(payload))
            .when(tag == "image_group", image_group_text(payload))
            .otherwise(unknown_text(tag, payload, options.drop_unknown_markers))
        )

    return F.array_join(F.transform(parts, one), "")


def with_citations(text: Column, order: Column, options: CleanerOptions) -> Column:
    if options.cite_mode != "footnote":
        return text
    notes = F.transform(
        order, lambda s, i: F.concat(F.lit("[^"), (i + 1).cast("string"), F.lit("]: "), s)
    )
    block = F.concat(F.lit("## Citations\n"), F.array_join(notes, "\n"), F.lit("\n"))
    head = rstrip(text)
    return F.when(F.size(order) == 0, text).when(head == "", block).otherwise(
        F.concat(head, F.lit("\n\n"), block)
    )


def cleaned(text: Column, options: CleanerOptions) -> Column:
    """``struct<text, dirty, order, parts>`` of an applied clean-up."""

    def finish(p: Column) -> Column:
        return let(
            source_order(p),
            lambda o: let(
                with_citations(replaced(p, o, options), o, options),
                lambda t: F.struct(
                    sub(t, K.MARK_RANGE).alias("text"), t.alias("dirty"), o.alias("order"), p.alias("parts")
                ),
            ),
        )

    return let(pieces(text), finish)


def is_active(text: Column, mode: str) -> Column:
    if mode == "on":
        return F.lit(True)
    return F.lit(False) if mode == "off" else has_markers(text)


def clean_text(text: Column, options: CleanerOptions) -> Column:
    return F.when(is_active(text, options.activation_mode), cleaned(text, options)["text"]).otherwise(text)


def report(text: Column, options: CleanerOptions) -> Column:
    """One struct of counters per document."""
    active = is_active(text, options.activation_mode)

    def counters(c: Column) -> Column:
        tags = F.transform(F.filter(c["parts"], lambda p: p["tag"].isNotNull()), lambda p: p["tag"])

        def tagged(name: str) -> Column:
            return F.when(c.isNotNull(), F.size(F.filter(tags, lambda t: t == name))).otherwise(F.lit(0))

        known = ("cite", "entity", "image_group")
        out = F.coalesce(c["text"], text)
        return F.struct(
            has_markers(text).alias("markers_detected"),
            active.alias("applied"),
            (out != text).alias("was_modified"),
            F.length(text).alias("original_size"),
            F.length(out).alias("cleaned_size"),
            tagged("cite").alias("cite_markers"),
            tagged("entity").alias("entity_markers"),
            tagged("image_group").alias("image_group_markers"),
            F.when(c.isNotNull(), F.size(F.filter(tags, lambda t: ~t.isin(*known)))).otherwise(F.lit(0)).alias("unknown_markers"),
            (
                F.when(c.isNotNull(), F.size(c["order"])).otherwise(F.lit(0))
                if options.cite_mode == "footnote" else F.lit(0)
            ).alias("footnotes_emitted"),
            F.when(c.isNotNull(), F.length(c["dirty"]) - F.length(c["text"])).otherwise(F.lit(0)).alias("leftover_pua_removed"),
        )

    return let(F.when(active, cleaned(text, options)), counters)
