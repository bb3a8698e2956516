"""What the trained operators share: a bounded sample of labelled rows, and gradient steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored

#: Labelled texts that a classifier is fitted on, and the characters of all of them together, at most.
SAMPLE_ROWS = 6_000
SAMPLE_CHARS = 40_000_000
#: A text of more than this part of the characters of its label is long: those that are not come first.
LONG = 100


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> DataFrame:
    """``(id, y)`` of the ids that have a label and are not held out; one label per id."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y"))
    return known.filter(~held_out("id", folds, fold))


def training_sample(
    docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS
) -> list[tuple[str, int]]:
    """``(text, y)`` of at most ``limit`` documents of ``known`` ``(id, y)`` with ``chars`` characters together.

    Each label has the share of both budgets that it has of the documents, and what one leaves goes to the other. Within a
    label they are the first in the order of a hash of the id, texts of more than a LONG-th of its characters last; one that
    does not fit is skipped for those behind it. A label of which nothing fits is stood for by its shortest text, the one
    case that passes ``chars``, so both labels are there if both are known. Whole texts are taken; the rows, not the texts,
    are sampled. Only ids and sizes are shuffled to choose them; the chosen ids are broadcast to fetch the texts.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    at = F.xxhash64(F.lit("sample"), "id").alias("at")
    sizes = texts.select("id", F.char_length("text").alias("n")).join(known, "id").groupBy("id", "y").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    sizes = stored(sizes, "sizes")
    counts = {r["y"]: r["rows"] for r in sizes.groupBy("y").agg(F.sum("rows").alias("rows")).collect()}
    shares = {y: (max(1, limit * n // sum(counts.values())), max(1, chars * n // sum(counts.values()))) for y, n in sorted(counts.items())}
    chosen, left = {}, [limit, chars]

    def take(candidates: list, y: int, rows: int, size: int) -> tuple[int, int]:
        for r in candidates:
            if r["id"] not in chosen and r["rows"] <= min(rows, left[0]) and r["n"] <= min(size, left[1]):
                chosen[r["id"]] = int(y)
                rows, size = rows - r["rows"], size - r["n"]
                left[0], left[1] = left[0] - r["rows"], left[1] - r["n"]
        return rows, size

    found = {}
    for y, (rows, size) in shares.items():
        own, long = sizes.filter(F.col("y") == y), F.col("n") * LONG > size
        found[y] = [r for part in (own.filter(~long), own.filter(long & (F.col("n") <= chars))) for r in part.orderBy(at, "id").limit(limit).collect()]
        take(found[y], y, rows, size)
    for y in shares:
        take(found[y], y, *left)
    for y in set(shares) - set(chosen.values()):
        chosen[sizes.filter(F.col("y") == y).orderBy("n", at, "id").first()["id"]] = int(y)
    if not chosen:
        return []
    kind = texts.schema["id"].dataType.simpleString()
    side = docs.sparkSession.createDataFrame(list(chosen.items()), f"id {kind}, y int")
    rows = texts.join(F.broadcast(side), "id").orderBy(at, "id").limit(max(limit, len(shares)))
    return [(r["text"], r["y"]) for r in rows.select("text", "y").collect()]


class Adam:
    """Gradient steps with moment estimates, over named arrays."""

    def __init__(self, values: dict[str, np.ndarray], rate: float):
        self.values, self.rate, self.t = values, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in values.items()}
        self.v = {k: np.zeros_like(v) for k, v in values.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            self.values[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def area_under_curve(scores: np.ndarray, labels: np.ndarray) -> float:
    """Probability that a positive scores above a negative; ties count half."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for value in np.unique(scores[order][np.flatnonzero(np.diff(scores[order]) == 0)]):
        ranks[scores == value] = ranks[scores == value].mean()
    positive = labels == 1
    n, k = positive.sum(), (~positive).sum()
    return float((ranks[positive].sum() - n * (n + 1) / 2) / max(n * k, 1))


Score = Callable[[str], float]
