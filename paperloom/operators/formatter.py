"""Restructuring of collapsed text over ``(doc_id, text)``; all narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaner as C
from ..functions import formatter as G
from ..functions.text import let
from ..options import CleanerOptions
from .structure import explode_rows


def needs_formatting(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", G.needs_formatting(F.col("text")).alias("needs_formatting"))


def format_routing(corpus: DataFrame) -> DataFrame:
    path = F.when(G.has_structure(F.col("text")), F.lit("light")).otherwise(F.lit("full"))
    return corpus.select("doc_id", path.alias("path"))


def rewrite(corpus: DataFrame, step, shield: bool = False) -> DataFrame:
    """Apply one text step to every document, optionally with protected spans."""
    text = F.col("text")
    new = G.shielded(text, lambda t, restore: restore(step(t))) if shield else step(text)
    return corpus.select("doc_id", new.alias("text"))


def protected_spans(corpus: DataFrame) -> DataFrame:
    """Spans no rewrite may touch: ``(doc_id, kind, pos, span)``."""

    def found(t: Column) -> Column:
        def kind(name: str, items: Column) -> Column:
            return F.transform(items, lambda x, i: F.struct(F.lit(name).alias("kind"), i.alias("pos"), x.alias("span")))

        return let(
            G.hide_spans(t, G.K.MATH_SPAN, G.K.PART),
            lambda m: let(
                G.hide_spans(m["text"], G.K.INLINE_MATH, G.K.HARD),
                lambda i: F.concat(
                    kind("math_block", m["store"]),
                    kind("math_inline", i["store"]),
                    kind("bold", F.regexp_extract_all(i["text"], F.lit(G.K.BOLD_SPAN), F.lit(0))),
                ),
            ),
        )

    out = explode_rows(corpus, ["doc_id"], let(F.col("text"), found), "p", "s")
    return out.select("doc_id", "s.kind", "s.pos", "s.span")


def head_fields(corpus: DataFrame) -> DataFrame:
    """Report head fields: ``(doc_id, key, value)``; the title has key ``title``."""

    def entries(h: Column) -> Column:
        title = F.array(F.struct(F.lit("title").alias("key"), h["title"].alias("value")))
        return F.filter(F.concat(title, h["fields"]), lambda f: f["value"].isNotNull())

    head = let(G.head_fields(F.col("text")), entries)
    return explode_rows(corpus, ["doc_id"], head, "p", "f").select("doc_id", "f.key", "f.value")


def head_frontmatter(corpus: DataFrame) -> DataFrame:
    return corpus.select(
        "doc_id", let(G.head_fields(F.col("text")), G.head_frontmatter).alias("frontmatter")
    )


def format_corpus(corpus: DataFrame, cleaner: CleanerOptions | None = None) -> DataFrame:
    """Optional marker clean-up, then light or full restructuring."""
    text = F.col("text") if cleaner is None else C.clean_text(F.col("text"), cleaner)
    return corpus.select("doc_id", let(text, G.format_text).alias("text"))
