"""Language identification by inference of a multilingual mixture.

Training counts character trigrams per language over all labelled documents: every task adds up its own table, Spark adds
the tables. A document is taken as a mixture: each trigram is drawn from one of the languages, in unknown proportions.
Expectation-maximisation estimates the proportions from the trigrams' likelihoods. Of the nested sets of its likeliest
languages the one with the best penalised likelihood is selected (overlapping trigrams count a third each, every further
language costs half the logarithm of their number), and the proportions within it are the result.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any labelled document every
text is; rows with a null label or id are not learned from; texts are read whole, whatever their length; repeated rows
agree; an empty table gives an empty result; the added column gets a free name if one of that name is there. All sets
are tried down to the least proportions, so the work grows with the square of the number of languages that are learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, held_out

FOLDS, HELD_OUT = 4, 2
#: Trigrams are hashed into so many buckets.
BUCKETS = 1 << 15
#: Characters that are worked on at once.
AT_ONCE = 300_000
SMOOTHING = 0.5
ROUNDS, FINAL_ROUNDS = 8, 6


def letter_table() -> np.ndarray:
    """Whether a code point is a letter (or a mark that belongs to one)."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def trigrams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, bucket)`` of every trigram over letters and single spaces, a space at either end of a text.

    Trigrams without a letter in the middle are left out; a text without letters has none.
    """
    joined = "\x00".join(f" {t} " for t in texts).lower()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = code == 0
    is_letter = letters[np.minimum(code, 0x10FFFF)]
    keep = is_letter | ends
    keep[1:] |= ~keep[1:] & (is_letter | ends)[:-1]  # the first of a run of other characters becomes the space
    keep[:1] = True
    owner = np.cumsum(ends)[keep]
    code = np.where(is_letter, code, 32)[keep].astype(np.uint64)
    is_letter = is_letter[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (code[:-2] * np.uint64(0x9E3779B1) ^ code[1:-1] * np.uint64(0x85EBCA77) ^ code[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F165667C5)
    inside = is_letter[1:-1]
    return owner[1:-1][inside].astype(np.int64), (mixed >> np.uint64(49)).astype(np.int64)[inside]


def groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """``(number of the first, texts)``: neighbours of about AT_ONCE characters together; a text is never cut."""
    first, size, own = 0, 0, []
    for k, t in enumerate(texts):
        own.append(t.replace("\x00", " "))
        size += len(t)
        if size >= AT_ONCE:
            yield first, own
            first, size, own = k + 1, 0, []
    if own:
        yield first, own


@dataclass
class LanguageModel:
    languages: list[str]
    chances: np.ndarray  # bucket x language

    @classmethod
    def from_counts(cls, languages: list[str], counts: np.ndarray) -> LanguageModel:
        smoothed = counts + SMOOTHING
        return cls(languages, (smoothed / smoothed.sum(axis=0)).astype(np.float32))

    def mixtures(self, texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (text x language, zero without letters) and scores of the first language."""
        n, m = len(texts), len(self.languages)
        share, score = np.zeros((n, m)), np.zeros(n)
        owner, bucket = trigrams(texts, letters)
        if not len(owner) or not m:
            return share, score
        cell, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
        owner, bucket = np.divmod(cell, BUCKETS)
        present, starts = np.unique(owner, return_index=True)
        sizes = np.diff(np.append(starts, len(owner)))
        p, c = self.chances[bucket], times.astype(np.float32)
        total = np.add.reduceat(c, starts)
        alone = np.add.reduceat(c[:, None] * np.log(p), starts)

        def em(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(rounds):
                joint = p * np.repeat(pi, sizes, axis=0)
                joint *= (c / joint.sum(axis=1))[:, None]
                pi = np.add.reduceat(joint, starts) / total[:, None]
            return pi, np.add.reduceat(c * np.log((p * np.repeat(pi, sizes, axis=0)).sum(axis=1)), starts)

        first = alone.argmax(axis=1)
        rows = np.arange(len(present))
        odds = np.exp((alone - alone.max(axis=1, keepdims=True)) / 3)
        best_share = np.zeros((len(present), m), np.float32)
        best_share[rows, first] = 1
        best_score = (odds.max(axis=1) / odds.sum(axis=1)).astype(float)
        best = alone[rows, first] / 3
        if m > 1:
            full, _ = em(np.full((len(present), m), 1 / m, np.float32), ROUNDS)
            rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
            for k in range(2, m + 1):  # the penalty alone decides
                inside = rank < k
                pi = np.where(inside, np.maximum(full, 1e-6), 0).astype(np.float32)
                pi, fit = em(pi / pi.sum(axis=1, keepdims=True), FINAL_ROUNDS)
                value = fit / 3 - (k - 1) * 0.5 * np.log(np.maximum(total, 2))
                better = value > best
                best_share[better], best[better] = pi[better], value[better]
                best_score[better] = pi[better].max(axis=1)
        share[present], score[present] = best_share, best_score
        return share, score


def train_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, fold: int = HELD_OUT
) -> LanguageModel:
    """Count trigrams over all documents with a language and an id that are not held out."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, tables = letter_table(), {}
        for batch in batches:
            for lang, own in batch.groupby("lang")["text"]:
                table = tables.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, texts in groups(own.tolist()):
                    table += np.bincount(trigrams(texts, letters)[1], minlength=BUCKETS)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            # a language whose texts have no letter is learned too, with nothing to show for it
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": table[at]}) if len(at) else pd.DataFrame({"lang": [lang], "bucket": [0], "n": [0]})

    counted = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most languages x BUCKETS numbers
    languages = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found["bucket"].to_numpy(dtype=np.int64), np.searchsorted(languages, found["lang"].to_numpy(dtype=str)) if languages else []] = found["n"]
    return LanguageModel.from_counts(languages, counts)


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with ``out_col``: ``lang``, ``score`` and ``shares``, the languages of the text by falling proportion."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    @F.pandas_udf("lang string, score double, shares array<struct<lang: string, share: double>>")
    def identified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters, names = letter_table(), shared.value.languages
        for texts in batches:
            texts, out = ["" if t is None else t for t in texts], []
            for _, own in groups(texts):
                share, score = shared.value.mixtures(own, letters)
                for row, s in zip(share, score, strict=True):
                    order = [k for k in np.argsort(-row, kind="stable") if row[k] > 0]
                    out.append((names[order[0]] if order else "und", float(s), [{"lang": names[k], "share": float(row[k])} for k in order]))
            yield pd.DataFrame(out, columns=["lang", "score", "shares"])

    return docs.withColumn(free_name(docs, out_col), identified(F.col(text_col)))
