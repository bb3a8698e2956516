"""Quality by attention-based multiple-instance learning: passages are the instances, documents carry the labels.

A document is cut into passages of ``PASSAGE`` words. Every passage is encoded: measured features go through a learned
layer to a vector h. Gated attention weighs the passages, a = softmax(w . (tanh(V h) * sigmoid(U h))), and the score is
a logistic function of the weighted passage representation, sum(a h). All layers are fitted together, by gradient steps
on the document labels. Scoring returns the attention weights too, so the passages that decided can be read off.

Defined cases: null and empty texts are one passage without words; labels other than 0 and 1 and null ids in the labels
are ignored; without labelled rows of both classes every text scores the share of label 1 (0.5 if there is none);
repeated rows score alike; texts of any length are scored whole; an empty table gives an empty result; the added column
gets a free name if one of that name is there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .training import Adam, labelled, sigmoid, training_sample

FOLDS, HELD_OUT = 5, 0
GOOD_FROM = 0.3
PASSAGE = 80
PASSAGES = re.compile(r"(?:\S+\s*){1,%d}" % PASSAGE)
#: ASCII characters by kind; bytes beyond ASCII count as letters.
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = b"0123456789"
SENTENCE_MARKS = b".,;:?'\"-()"
FEATURES = 18
HIDDEN, GATE = 16, 8


def passages(text: str) -> list[tuple[int, str]]:
    """``(start, passage)``: stretches of PASSAGE words; a text without words is one passage."""
    return [(m.start(), m[0]) for m in PASSAGES.finditer(text)] or [(0, text)]


def passage_features(passage: str, seen: Counter) -> list[float]:
    """Features of a passage; ``seen`` counts the lines of the document so far."""
    raw, words = passage.encode(), passage.split()
    n = len(raw) or 1
    count = lambda kind: (len(raw) - len(raw.translate(None, kind))) / n
    upper, lower, digits, marks, space = count(UPPER), count(LOWER), count(DIGITS), count(SENTENCE_MARKS), count(b" \t\r\n")
    times = Counter(words)
    w = len(words) or 1
    lines = [x for x in passage.split("\n") if x.strip()]
    again = sum(seen[x] > 0 for x in lines) / (len(lines) or 1)
    seen.update(lines)
    follows = sum(a == b for a, b in zip(words, words[1:]))
    pairs = set(zip(words, words[1:]))
    return [
        np.log1p(len(words)), upper, lower, digits, marks, space, 1 - upper - lower - digits - marks - space,
        raw.count(b"!") / w, upper / (upper + lower + 1e-3), len(times) / w, max(times.values(), default=0) / w, follows / w,
        1 - len(pairs) / max(w - 1, 1), (n / w) / 10, np.log1p(len(lines)), again,
        sum(map(raw.count, (b"#", b"$", b"%", b"&", b"*"))) / w, raw.count(b"|") / w,
    ]


def document_features(text: str | None) -> np.ndarray:
    seen: Counter = Counter()
    return np.array([passage_features(p, seen) for _, p in passages(text or "")])


@dataclass
class QualityModel:
    """Parameters by name; None if nothing could be learned, then ``prior`` is every score."""

    prior: float
    values: dict[str, np.ndarray] | None = None

    def scores(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the documents whose passages begin at ``starts``, and the attention on every passage."""
        sizes = np.diff(np.append(starts, len(x)))
        if self.values is None:
            return np.full(len(starts), self.prior), 1 / np.repeat(sizes, sizes)
        f = forward(self.values, x, starts, sizes)
        return f["score"], f["a"]


def forward(v: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    x = (x - v["mean"]) / v["scale"]
    h = np.tanh(x @ v["W"] + v["b"])
    t, g = np.tanh(h @ v["V"]), sigmoid(h @ v["U"])
    e = (t * g) @ v["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": sigmoid(z @ v["c"] + v["d"][0])}


def fit_quality(sample: list[tuple[str, int]], steps: int = 150, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> QualityModel:
    y = np.array([y for _, y in sample], dtype=float)
    if not len(y) or y.min() == y.max():
        return QualityModel(float(y.mean()) if len(y) else 0.5)
    made = [document_features(t) for t, _ in sample]
    sizes = np.array([len(m) for m in made])
    starts, x = np.cumsum(sizes) - sizes, np.vstack(made)
    random = np.random.default_rng(seed)
    drawn = lambda *shape: random.normal(0, 1 / np.sqrt(shape[0]), shape)
    v = {
        "W": drawn(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": drawn(HIDDEN, GATE), "U": drawn(HIDDEN, GATE), "w": drawn(GATE),
        "c": drawn(HIDDEN), "d": np.array([np.log(y.mean() / (1 - y.mean()))]),
    }
    fixed = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-6}
    adam = Adam(v, rate)
    for _ in range(steps):
        f = forward(v | fixed, x, starts, sizes)
        ds = (f["score"] - y) / len(y)
        dz = np.repeat(ds[:, None] * v["c"], sizes, axis=0)
        h, a, t, g = f["h"], f["a"], f["t"], f["g"]
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, dg = de[:, None] * v["w"] * g * (1 - t * t), de[:, None] * v["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ v["V"].T + dg @ v["U"].T) * (1 - h * h)
        gradients = {
            "W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de,
            "c": f["z"].T @ ds, "d": np.array([ds.sum()]),
        }
        adam.step({k: g + decay * v[k] for k, g in gradients.items()})
    return QualityModel(float(y.mean()), v | fixed)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> QualityModel:
    return fit_quality(training_sample(docs, labelled(labels, label, id_col, FOLDS, HELD_OUT), id_col, text_col))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """``docs`` with ``out_col``: ``score`` and the passages as ``(start, length, weight)`` in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    @F.pandas_udf("score double, passages array<struct<start: int, length: int, weight: double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            cut = [passages(t or "") for t in texts]
            made = [document_features(t) for t in texts]
            if not made:
                continue
            sizes = np.array([len(m) for m in made])
            starts = np.cumsum(sizes) - sizes
            scores, weights = shared.value.scores(np.vstack(made), starts)
            found = [
                [{"start": p, "length": len(s), "weight": float(w)} for (p, s), w in zip(own, weights[k : k + len(own)], strict=True)]
                for own, k in zip(cut, starts, strict=True)
            ]
            yield pd.DataFrame({"score": scores, "passages": pd.Series(found, dtype=object)})

    return docs.withColumn(free_name(docs, out_col), scored(F.col(text_col)))
