"""Maximal periodic runs of words, found by multi-scale minimizers.

A run is a stretch of consecutive words whose smallest period is ``q`` (words ``q`` apart are identical), at least
``max(LEAST_WORDS, LEAST_POWER * q)`` words long, that no neighbouring word extends keeping that period. Two ways find all
of them, by their period:

* periods up to ``SHORT``: the text is laid against itself at every lag, and long enough stretches of equal words stay;
* longer ones, by scales. A scale serves the periods from ``least`` to ``width = 3 * least // 2``. Every place stands for
  the ``width`` words from there on, by a hash; the least hash of each window of ``2 * least - width + 1`` places is its
  minimizer. A run of three periods holds the first window and the one a period later whole, so its minimizer comes back
  a period later; and as ``width`` words cover a period of it, the same words don't return sooner. So neighbouring
  minimizers of one scale with equal hashes are a period apart: they are the seeds. Each is extended word by word on
  both sides, kept if it is long enough, and dropped if a part of its period is a period already.

Extension compares the words themselves, so nothing that is returned rests on a hash; a run can be missed only where two
64-bit hashes of different words fall together. Texts of an Arrow batch are laid end to end with a separate mark between
them, in order of length, so that a scale is computed once for all texts that are long enough to have such periods.
A text is worked on whole, in time that grows with its words times the number of scales (their widths grow by half).

Defined cases: null and empty texts, and texts of white space, have no words and no runs; ids may be null or repeat: each
row is worked on by itself; an empty table gives an empty result; the user's other columns, whatever their names, are
carried along in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

LEAST_WORDS, LEAST_POWER = 24, 3
#: Periods up to this are found by laying the text against itself.
SHORT = 8
#: Words of the texts that are laid end to end; a longer text is alone.
BATCH_WORDS = 1 << 18

RUN = "struct<start: long, length: long, period: long>"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Hashes of all stretches of a given number of words, built by doubling."""

    def __init__(self, words: np.ndarray):
        self.doubled = [_mixed(words.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15))]

    def of(self, width: int, size: int) -> np.ndarray:
        """For the stretches that begin and end in the first ``size`` words."""
        top = width.bit_length() - 1
        while len(self.doubled) <= top:
            last, half = self.doubled[-1], 1 << (len(self.doubled) - 1)
            self.doubled.append(_mixed(last[: max(len(last) - half, 0)], last[half:]))
        one, n = self.doubled[top], max(size - width + 1, 0)
        rest = width - (1 << top)
        return _mixed(one[:n], one[rest : rest + n]) if rest else one[:n]


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """The places whose hash is the least of some whole window."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    least = _window_least(hashes, window)
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    return np.flatnonzero(~_window_least(~padded, window) == hashes)


def _matched(words: np.ndarray, left: int, right: int, step: int) -> int:
    """How many words agree from two places on, to the right (``step`` 1) or to the left (-1)."""
    found, block = 0, 64
    while True:
        room = len(words) - right - found if step > 0 else left + 1 - found
        take = min(block, room)
        if take <= 0:
            return found
        if step > 0:
            differ = words[left + found : left + found + take] != words[right + found : right + found + take]
        else:
            a, b = left - found, right - found
            differ = (words[a - take + 1 : a + 1] != words[b - take + 1 : b + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return found + at
        found, block = found + take, 2 * block


def _smallest(words: np.ndarray, start: int, period: int) -> bool:
    """Whether no proper divisor of a period of a run is a period as well."""
    rest, factor, of = period, 2, []
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            of.append(period // factor)
            while rest % factor == 0:
                rest //= factor
        factor += 1
    own = words[start : start + period]
    return not any(np.array_equal(own[: period - q], own[q:]) for q in of)


def _least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_POWER * period)


def _short_runs(words: np.ndarray, short: int) -> Iterator[tuple[int, int, int]]:
    for q in range(1, short + 1):
        if len(words) <= q:
            return
        same = np.flatnonzero(np.diff(np.concatenate([[False], words[:-q] == words[q:], [False]]).view(np.int8)))
        begins, ends = same[::2], same[1::2] + q
        for k in np.flatnonzero(ends - begins >= _least_length(q)):
            if _smallest(words, int(begins[k]), q):
                yield int(begins[k]), int(ends[k] - begins[k]), q


def _long_runs(words: np.ndarray, sizes: np.ndarray, short: int) -> Iterator[tuple[int, int, int]]:
    """``sizes``: the lengths of the texts that are laid end to end, falling; each has a mark behind it."""
    hashes, ends = _Hashes(words), np.cumsum(sizes + 1)
    least = short + 1
    while (n_texts := int(np.count_nonzero(sizes >= _least_length(least)))) > 0:
        width = 3 * least // 2
        here = hashes.of(width, int(ends[n_texts - 1]))
        at = _minimizers(here, 2 * least - width + 1)
        order = np.argsort(here[at], kind="stable")
        keys, at = here[at][order], at[order]
        lag = at[1:] - at[:-1]
        seed = np.flatnonzero((keys[1:] == keys[:-1]) & (lag >= least) & (lag <= width))
        at, lag = at[seed], lag[seed]
        done = (0, 0)  # the period and the end of what the last seed was extended to
        for k in np.lexsort((at, lag)):
            p, q = int(at[k]), int(lag[k])
            if done[0] == q and p + q < done[1]:
                continue
            end = p + q + _matched(words, p, p + q, 1)
            start = p - _matched(words, p - 1, p + q - 1, -1)
            done = (q, end)
            if end - start >= _least_length(q) and _smallest(words, start, q):
                yield start, end - start, q
        least = width + 1


def runs_of(texts: list[list], short: int = SHORT) -> list[list[tuple[int, int, int]]]:
    """For every list of words its runs ``(start, length, period)`` by start, then period."""
    by_length = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in by_length], np.int64)
    numbers: dict = {}
    words = np.empty(int(sizes.sum()) + len(sizes), np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    for mark, (k, s) in enumerate(zip(by_length, starts, strict=True)):
        own = texts[k]
        words[s : s + len(own)] = [numbers.setdefault(w, len(numbers)) for w in own]
        words[s + len(own)] = -1 - mark
    long_enough = int(np.count_nonzero(sizes >= LEAST_WORDS))
    used = words[: int((sizes[:long_enough] + 1).sum())]
    found: list[list] = [[] for _ in texts]
    for runs in (_short_runs(used, short), _long_runs(used, sizes[:long_enough], short)):
        for start, length, q in runs:
            text = int(np.searchsorted(starts, start, side="right")) - 1
            found[by_length[text]].append((start - int(starts[text]), length, q))
    return [sorted(set(r), key=lambda r: (r[0], r[2])) for r in found]


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """What is left when every run loses all but its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(change), strict=False) if not n]


def periodic_runs(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """``row, n_words, runs, collapsed`` for every row of ``docs``.

    ``runs`` are ``(start, length, period)`` in words from 0, by start, then period; ``collapsed`` is the text without the
    words that a run holds after its first period, its words joined by one space.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, texts = 0, 0, []
            for at, value in enumerate(batch.column("text")):
                texts.append((value.as_py() or "").encode("utf-8", "surrogatepass").split())  # at ASCII white space only
                size += len(texts[-1])
                if size >= BATCH_WORDS:
                    yield told(batch.slice(begin, at + 1 - begin), texts)
                    begin, size, texts = at + 1, 0, []
            if texts:
                yield told(batch.slice(begin), texts)

    def told(batch: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts)
        columns = [
            batch.column("row"), pa.array([len(w) for w in texts], pa.int64()),
            pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found], RUNS_ARROW),
            pa.array([b" ".join(_kept(w, r)) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "runs", "collapsed"])

    rows = packed(docs, text=F.col(text) if isinstance(text, str) else text)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(read, f"row {kind}, n_words long, runs array<{RUN}>, collapsed string")


RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def greatest_run(runs: Column) -> Column:
    """The run with the greatest length for its period, by exact comparison; then the smallest start, then period. Or null."""

    def order(a: Column, b: Column) -> Column:
        one, other = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(one != other, F.signum(other - one)).when(
            a["start"] != b["start"], F.signum(a["start"] - b["start"])
        ).otherwise(F.signum(a["period"] - b["period"])).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))


def rotated_text(doc_id: Column, text: Column) -> Column:
    """The text whose words follow a period from some word on, for a tenth of all ids (by crc32); others as they are."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    g = F.floor(h / 10)

    def of(s: Column) -> Column:
        a, p, words = s["a"], s["p"], s["w"]
        tail = F.transform(F.slice(words, a + 1, F.size(words)), lambda _, i: F.get(words, (a + i % p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")

    def places(w: Column) -> Column:
        a = (g % F.size(w)).cast("int")
        return F.struct(w.alias("w"), a.alias("a"), (1 + F.floor((F.size(w) - a) / (3 + g % 8))).cast("int").alias("p"))

    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  evaluates value once
    edited = let(words, lambda w: F.when(F.size(w) > 0, let(places(w), of)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, edited).otherwise(text)
