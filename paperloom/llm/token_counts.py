"""Token counts of a piece (sentencepiece BPE) vocabulary by whole-token shortcut.

White space is the only place where pieces of such a vocabulary can end in any case: ``load_counter`` proves from the
vocabulary that no piece has a space mark after another character, and that none holds a line break. Then every merge
stays inside a pre-token (spaces and what follows up to the next space or line break), and the counts of the pre-tokens
add up. It proves further, string by string, which vocabulary entries encode alone as exactly one token; pre-tokens
among these count 1 without any merging. Only the rest goes through the library's merges (with a bounded memory of
results). A vocabulary for which the proof fails is counted by encoding whole texts.

Defined cases: null and empty texts have 0 tokens; texts of any length are counted whole; strings of control tokens in
a text are ordinary text; repeated rows, null ids, other columns and empty tables pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
PRE_TOKENS = re.compile(" *[^ \n]+| +|\n+").findall
#: Results of merges that a worker remembers (about 60 MB and those of one text) before it starts anew.
REMEMBERED = 400_000
TOKEN_LIMIT = 4096


def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def prove_whole_tokens(path: str) -> frozenset[str] | None:
    """The pre-tokens (spaces for space marks) that encode alone as one token; None if pre-tokens can't be kept apart."""
    model = load_model(path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    pieces = {i: model.id_to_piece(i) for i in ordinary}
    apart = not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces.values())
    # a dummy space before every text, spaces kept as they are, a line break in one token of its own
    apart = apart and [len(model.encode(x)) for x in ("", "\n", "\n\n", " \n")] == [0, 2, 3, 2]
    if not apart:
        return None
    # after a line break a pre-token has no space; the break and the dummy space are the two tokens before it
    alone = {i: model.encode(p[1:].replace(MARK, " ")) if p[0] == MARK else model.encode("\n" + p)[2:] for i, p in pieces.items()}
    return frozenset(p.replace(MARK, " ") for i, p in pieces.items() if alone[i] == [i])


class TokenCounter:
    """Counts tokens of texts; ``whole`` comes from ``prove_whole_tokens``."""

    def __init__(self, path: str, whole: frozenset[str] | None):
        self.model, self.whole, self.rest = load_model(path), whole, {}
        self.line_break = self.model.encode("\n")[-1]

    def _merge(self, chunks: set[str]) -> None:
        """Encode the chunks in one go, kept apart by line breaks, and remember their counts."""
        self.rest.update((c, len(c)) for c in chunks if c[0] == "\n")
        spoken = [c for c in chunks if c[0] != "\n"]
        ids = np.array(self.model.encode("\n" + "\n".join(spoken) + "\n" if spoken else ""), dtype=np.int64)
        breaks = np.flatnonzero(ids == self.line_break)
        self.rest.update(zip(spoken, (np.diff(breaks) - 1).tolist(), strict=True))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.whole is None:
            return len(self.model.encode(text))
        chunks = PRE_TOKENS(" " + text.replace(MARK, " "))
        rest = [c for c in chunks if c not in self.whole]
        if len(self.rest) > REMEMBERED:
            self.rest.clear()
        if new := {c for c in rest if c not in self.rest}:
            self._merge(new)
        return len(chunks) - len(rest) + sum(map(self.rest.__getitem__, rest))


def token_count(spark: SparkSession, text: str | Column, path: str) -> Column:
    """A column with the number of tokens of ``text`` under the model at ``path`` (a path on every machine)."""
    whole = spark.sparkContext.broadcast(prove_whole_tokens(path))  # at most the vocabulary

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(path, whole.value)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return counted(F.col(text) if isinstance(text, str) else text)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with ``out_col``; a column of that name that is there already is replaced."""
    return docs.withColumn(out_col, token_count(docs.sparkSession, text_col, path))
