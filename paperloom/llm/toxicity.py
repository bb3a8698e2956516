"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence has probability p = sigmoid(bias + sum of the weights of its features); a document is toxic if any sentence
is, so its score is the noisy-or 1 - product(1 - p). The weights are fitted by gradient steps on the likelihood of the
document labels, with an L1 step that keeps only features that matter. Features are whole words and the beginnings of
words, so that inflected forms of one stem share weight. The fitted model then scores any text and locates the
sentences that carry the score.

Defined cases: null and empty texts have no sentence and score 0; one sentence may be of any length; labels other than
0 and 1 and null ids in the labels are ignored; if there is no labelled row, or only one class, every text scores 0
(or that class); repeated rows score alike; an empty table gives an empty result; the added column gets a free name if
one of that name is there.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .training import Adam, labelled, sigmoid, training_sample

FOLDS, HELD_OUT = 3, 1
TOXIC_FROM = 0.7
#: A sentence is an offending one from this probability.
SENTENCE_FROM = 0.5
STEMS = range(3, 8)
SENTENCES = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|$)")
WORDS = re.compile(r"[^\W\d_]+").findall
#: A feature must occur in so many training documents and be so far above the average; the model keeps the likeliest.
LEAST_DOCUMENTS = 4
LEAST_DEVIATION = 2.5
MOST_FEATURES = 20_000
REMEMBERED = 300_000


def word_features(word: str) -> list[str]:
    """The word itself, and its beginnings as ``stem*``."""
    return [word, *(word[:n] + "*" for n in STEMS if n < len(word))]


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """``(start, length, words)`` of the stretches of ``text`` that hold a word; a word counts once in a sentence."""
    for m in SENTENCES.finditer(text):
        words = set(WORDS(m[0].lower()))
        if words:
            yield m.start(), len(m[0]), words


@dataclass
class ToxicityModel:
    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self) -> SentenceScorer:
        return SentenceScorer(self)


class SentenceScorer:
    """Scores texts; remembers the weights of words."""

    def __init__(self, model: ToxicityModel):
        self.model, self.words = model, {}
        self.none = float(sigmoid(np.array(model.bias)))

    def weight(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            get = self.model.weights.get
            found = self.words[word] = sum(get(f, 0.0) for f in word_features(word))
        return found

    def __call__(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and ``(start, length, probability)`` of its offending sentences."""
        if not text:
            return 0.0, []
        clean, offending, plain = 0.0, [], 0
        for start, length, words in sentences(text):
            total = sum(map(self.weight, words))
            if total == 0.0:
                plain += 1
                continue
            p = 1 / (1 + np.exp(-min(max(self.model.bias + total, -40), 40)))
            clean += np.log1p(-min(p, 1 - 1e-12))
            if p >= SENTENCE_FROM:
                offending.append((start, length, float(p)))
        clean += plain * np.log1p(-self.none)
        return float(-np.expm1(clean)), offending


def fit_toxicity(sample: list[tuple[str, int]], steps: int = 300, rate: float = 0.1, l1: float = 0.1) -> ToxicityModel:
    """Fit bias and weights to ``(text, 0 or 1)`` by the noisy-or likelihood; ``l1`` is in documents."""
    labels = np.array([y for _, y in sample], dtype=float)
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel(bias=20.0 if len(labels) and labels.max() == 1 else -20.0)
    # every sentence as the numbers of its words; `ends` and `owner` say where it ends and whose it is
    vocabulary: dict[str, int] = {}
    numbers, ends, owner = array("l"), array("l"), array("l")
    for d, (text, _) in enumerate(sample):
        for _, _, words in sentences(text):
            numbers.extend(vocabulary.setdefault(w, len(vocabulary)) for w in words)
            ends.append(len(numbers))
            owner.append(d)
    numbers, ends, owner = (np.frombuffer(x, dtype=np.int64) if len(x) else np.zeros(0, np.int64) for x in (numbers, ends, owner))
    in_document = np.unique(np.repeat(owner, np.diff(ends, prepend=0)) * len(vocabulary) + numbers)
    words = list(vocabulary)
    seen: Counter = Counter()
    toxic: Counter = Counter()
    starts = np.searchsorted(in_document, np.arange(len(labels) + 1) * len(vocabulary))
    for d, y in enumerate(labels):
        own = {f for w in in_document[starts[d] : starts[d + 1]] % len(vocabulary) for f in word_features(words[w])}
        seen.update(own)
        if y:
            toxic.update(own)
    # standard deviations by which the share of toxic documents lies above the average
    share = labels.mean()
    above = {f: (toxic[f] - share * n) / np.sqrt(n * share * (1 - share)) for f, n in seen.items() if n >= LEAST_DOCUMENTS}
    useful = sorted((f for f, z in above.items() if z >= LEAST_DEVIATION), key=lambda f: (-above[f], f))
    names = {f: k for k, f in enumerate(useful[:MOST_FEATURES])}
    known = [[names[f] for f in word_features(w) if f in names] for w in words]
    del seen, toxic, above
    cells, columns, carrier = array("l"), array("l"), array("l")
    plain = np.zeros(len(labels))  # sentences without a feature
    telling = np.array([bool(k) for k in known], dtype=bool)
    for start, end, d in zip(np.append(0, ends[:-1]), ends, owner, strict=True):
        own = numbers[start:end]
        mine = {k for w in own[telling[own]] for k in known[w]}
        if not mine:
            plain[d] += 1
            continue
        cells.extend([len(carrier)] * len(mine))
        columns.extend(mine)
        carrier.append(d)
    cells, columns, owner = (np.frombuffer(x, dtype=np.int64) if len(x) else np.zeros(0, np.int64) for x in (cells, columns, carrier))
    n_docs, l1 = len(labels), l1 / len(labels)
    values = {"w": np.zeros(len(names)), "b": np.array([-6.0])}
    adam = Adam(values, rate)
    for _ in range(steps):
        p = sigmoid(values["b"][0] + np.bincount(cells, values["w"][columns], minlength=len(owner)))
        none = sigmoid(values["b"])[0]
        clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs) + plain * np.log1p(-none)
        score = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d likelihood / d logit of a sentence: p for toxic documents times the odds of being clean, -p for clean ones
        odds = np.where(labels == 1, (1 - score) / score, -1.0)
        pull = odds[owner] * p
        adam.step({
            "w": -np.bincount(columns, pull[cells], minlength=len(names)) / n_docs + l1 * np.sign(values["w"]),
            "b": np.array([-(pull.sum() + none * (odds * plain).sum()) / n_docs]),
        })
        values["w"][:] = np.sign(values["w"]) * np.maximum(np.abs(values["w"]) - rate * l1, 0)
    kept = {f: float(values["w"][k]) for f, k in names.items() if abs(values["w"][k]) > 0.05}
    return ToxicityModel(float(values["b"][0]), kept)


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> ToxicityModel:
    return fit_toxicity(training_sample(docs, labelled(labels, label, id_col, FOLDS, HELD_OUT), id_col, text_col))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with ``out_col``: ``score`` and the offending sentences as ``(start, length, p)`` in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights

    @F.pandas_udf("score double, sentences array<struct<start: int, length: int, p: double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        act = SentenceScorer(shared.value)
        for texts in batches:
            rows = [act(t) for t in texts]
            found = [[{"start": s, "length": n, "p": p} for s, n, p in x] for _, x in rows]
            yield pd.DataFrame({"score": [s for s, _ in rows], "sentences": pd.Series(found, dtype=object)})

    return docs.withColumn(free_name(docs, out_col), scored(F.col(text_col)))
