"""Expressions over the standard columns, built once per Spark application.

A Column is an unbound expression tree, so one tree serves every DataFrame that
has the columns it names (``text`` for corpora, ``code`` and ``lines`` for
blocks).  Building a tree costs thousands of calls into the JVM; reusing it
keeps planning time small.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..options import ParseOptions, RenderOptions
from . import audit as A
from . import footnotes as N
from . import lexer as L
from . import metadata as M
from . import render as R
from . import runs as RU
from . import tables as T
from .text import let


def per_application(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep built expressions for as long as the Spark application lives."""
    kept: dict = {}

    @functools.wraps(build)
    def get(*args) -> Column:
        session = SparkSession.getActiveSession()
        app = session.sparkContext.applicationId if session else None
        if kept.get("app") != app:
            kept.clear()
            kept["app"] = app
        if args not in kept:
            kept[args] = build(*args)
        return kept[args]

    return get


@per_application
def spans(strict: bool = False) -> Column:
    return L.block_spans(F.col("text"), strict)


@per_application
def document(strict: bool = False) -> Column:
    return M.document(F.col("text"), strict)


@per_application
def body_spans(strict: bool = False) -> Column:
    return let(document(strict), M.body_spans)


@per_application
def parsed_metadata() -> Column:
    return let(document(), M.parsed_metadata)


@per_application
def inferred_metadata() -> Column:
    return let(document(), M.inferred_metadata)


@per_application
def metadata_of() -> Column:
    """Inferred metadata of a document ``d`` that is parsed already."""
    return M.inferred_metadata(F.col("d"))


@per_application
def final_notes(caret: bool = False) -> Column:
    return let(N.definitions(F.col("text"), caret), N.final_notes)


@per_application
def record_source() -> Column:
    """A record whose blocks are not yet summarised, see ``audit.record_parts``."""
    return let(document(), lambda d: A.record_parts(d, F.size(final_notes()), "all"))


@per_application
def summarised_record() -> Column:
    return A.summarised_record(F.col("r"))


@per_application
def record_pair(parts: str = "all") -> Column:
    """Records of ``text_a`` and ``text_b`` in an array, which is null where the texts are equal, so nothing is parsed.

    ``parts`` says what is needed of them; ``audit.record_parts`` computes nothing else.
    """
    left, right = F.col("text_a"), F.col("text_b")

    def of(text: Column) -> Column:
        notes = F.lit(0) if parts == "metadata" else F.size(let(N.definitions(text, False), N.final_notes))
        return F.when(text.isNotNull(), let(M.document(text, False), lambda d: A.record_parts(d, notes, parts)))

    return F.when(~left.eqNullSafe(right), F.transform(F.array(left, right), of))


@per_application
def equal_ends() -> Column:
    return A.equal_ends(F.col("r"))


@per_application
def summarised_pair(parts: str) -> Column:
    return A.summarised_pair(F.col("r"), F.col("c"), parts)


@per_application
def moved_blocks() -> Column:
    return A.moved_blocks(F.col("before"), F.col("after"))


def _assembled(d: Column, options: RenderOptions, parse: ParseOptions) -> Column:
    body = F.transform(
        M.body_spans(d),
        lambda b: let(
            R.render_block(b["code"], b["lines"], options),
            lambda md: F.when(md != "", F.concat(md, F.lit("\n"))).otherwise(F.lit("")),
        ),
    )
    front = let(M.inferred_metadata(d), M.frontmatter_text) if options.include_frontmatter else F.lit("")
    notes = let(final_notes(parse.caret_definitions), N.endnotes_text)
    return F.array_join(F.filter(F.concat(F.array(front), body, F.array(notes)), lambda p: p != ""), "\n")


@per_application
def markdown(options: RenderOptions, parse: ParseOptions) -> Column:
    """Whole document ``d`` of ``text``: metadata block, body blocks, end notes."""
    return R.normalize_markdown(_assembled(F.col("d"), options, parse))


@per_application
def table_parts(keep_empty: bool = False) -> Column:
    return T.table_parts(F.col("lines"), keep_empty)


@per_application
def table_cell_texts() -> Column:
    return T.table_cell_texts(F.col("lines"))


@per_application
def column_profiles(keep_empty: bool = False) -> Column:
    return T.column_profiles(F.col("lines"), keep_empty)


@per_application
def block_markdown(options: RenderOptions) -> Column:
    return R.render_block(F.col("code"), F.col("lines"), options)


@per_application
def block_summary() -> Column:
    return A.block_summary(F.col("code"), F.col("lines"))


@per_application
def block_runs() -> Column:
    return RU.block_run_arrays(F.col("code"), F.col("lines"))
