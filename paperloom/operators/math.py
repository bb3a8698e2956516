"""Math expressions of ``(doc_id, …, text)`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import constants as K
from ..functions import exprs as E
from ..functions import tables as T
from ..functions.math_text import latex_to_text
from ..functions.text import let


def latex_texts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, latex_to_text(F.col("text")).alias("display"))


def _texts(b: Column) -> Column:
    """Texts of a block that can hold equations: one, or the cells of a table."""
    return F.when(b["code"] == "T", F.flatten(T.table_grid(b["lines"]))).otherwise(F.array(B.block_text(b["code"], b["lines"])))


def _matches(texts: Column, pattern: str) -> Column:
    return F.aggregate(texts, F.lit(0), lambda n, t: n + F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))


def equation_counts(corpus: DataFrame) -> DataFrame:
    """Block and inline equations per document, in one pass over its blocks.

    Paragraphs, items, headings, callouts, every cell of a table and the final notes are looked at, for ``$$...$$`` inside
    them too.
    """

    def counts(spans):
        blocks = F.filter(spans, lambda b: F.contains(F.lit("PBxNy1234WhQT"), b["code"]))
        notes = F.transform(E.final_notes(), lambda n: n["text"])
        return let(
            F.concat(F.flatten(F.transform(blocks, _texts)), notes),
            lambda texts: F.struct(
                (F.size(F.filter(spans, lambda b: F.contains(F.lit("LM"), b["code"]))) + _matches(texts, K.DISPLAY_MATH)).alias("block_equations"),
                _matches(texts, K.INLINE_MATH).alias("inline_equations"),
            ),
        )

    out = corpus.select("doc_id", let(E.spans(), counts).alias("c"))
    return out.select("doc_id", "c.block_equations", "c.inline_equations")
