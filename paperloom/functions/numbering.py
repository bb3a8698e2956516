"""Running numbers of nested lists over rows that arrive in document order, chunk by chunk.

The state of a document is, per list, the counters and formats of its levels. What a chunk of rows does to any state
is a summary of the same shape plus the shallowest level that it has touched, so chunks are folded on their own, their
summaries are carried over, and then every chunk is numbered from the state it starts with.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd


@dataclass
class OneList:
    counters: dict[int, int] = field(default_factory=dict)
    formats: dict[int, str] = field(default_factory=dict)
    shallowest: int | None = None

    def item(self, level: int, fmt: str | None) -> None:
        """Count an item; it ends the deeper levels."""
        for deeper in [n for n in self.counters if n > level]:
            del self.counters[deeper]
        self.counters[level] = self.counters.get(level, 0) + 1
        if fmt is not None:
            self.formats[level] = fmt
        self.shallowest = level if self.shallowest is None else min(self.shallowest, level)

    def then(self, later: OneList) -> OneList:
        """The state after this one and the rows that ``later`` sums up."""
        kept = {n: v for n, v in self.counters.items() if n <= later.shallowest}
        sums = {n: v + kept.pop(n, 0) for n, v in later.counters.items()}
        return OneList(kept | sums, self.formats | later.formats, later.shallowest)


@dataclass
class Lists:
    broken: bool = False
    lists: dict[str, OneList] = field(default_factory=dict)

    def row(self, key: str, level: int, fmt: str | None, is_break: bool) -> None:
        if is_break:
            self.broken = True
            self.lists.clear()
        else:
            self.lists.setdefault(key, OneList()).item(level, fmt)

    def parts(self, key: str, level: int) -> list[tuple[int, str]]:
        """Counters and formats of an item's label, outermost first."""
        own = self.lists[key]
        return [(v, own.formats.get(n, "decimal")) for n, v in sorted(own.counters.items()) if n <= level]

    def then(self, later: Lists) -> Lists:
        before = {} if later.broken else self.lists
        joined = {k: before[k].then(v) if k in before else v for k, v in later.lists.items()}
        return Lists(self.broken or later.broken, before | joined)

    def to_json(self) -> str:
        lists = {k: [list(v.counters.items()), list(v.formats.items()), v.shallowest] for k, v in self.lists.items()}
        return json.dumps([self.broken, lists])

    @classmethod
    def from_json(cls, text: str | None) -> Lists:
        if not text:
            return cls()
        broken, lists = json.loads(text)
        return cls(broken, {k: OneList(dict(c), dict(f), s) for k, (c, f, s) in lists.items()})


def _rows(batch: pd.DataFrame) -> Iterator[tuple]:
    columns = [batch[c].astype(object) for c in ("doc_id", "chunk", "block_idx", "list_key", "level", "num_fmt", "is_break")]
    for doc, chunk, at, key, level, fmt, is_break in zip(*columns, strict=True):
        yield doc, chunk, at, key, level if is_break else int(level), None if pd.isna(fmt) else fmt, bool(is_break)


def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(doc_id, chunk, summary)`` of rows sorted by document, chunk and position."""
    at, state = None, Lists()
    for batch in batches:
        done = []
        for doc, chunk, _, key, level, fmt, is_break in _rows(batch):
            if at != (doc, chunk):
                if at is not None:
                    done.append((*at, state.to_json()))
                at, state = (doc, chunk), Lists()
            state.row(key, level, fmt, is_break)
        yield pd.DataFrame(done, columns=["doc_id", "chunk", "summary"])
    if at is not None:
        yield pd.DataFrame([(*at, state.to_json())], columns=["doc_id", "chunk", "summary"])


def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(doc_id, chunk, start)``: the state before every chunk, from summaries sorted by document and chunk."""
    doc, state = None, Lists()
    for batch in batches:
        out = []
        for own, chunk, summary in zip(batch["doc_id"].astype(object), batch["chunk"], batch["summary"], strict=True):
            if own != doc:
                doc, state = own, Lists()
            out.append((own, chunk, state.to_json()))
            state = state.then(Lists.from_json(summary))
        yield pd.DataFrame(out, columns=["doc_id", "chunk", "start"])


def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(doc_id, block_idx, parts)`` of sorted rows that carry the state before their chunk in ``start``."""
    at, state = None, Lists()
    for batch in batches:
        out = []
        for (doc, chunk, block, key, level, fmt, is_break), start in zip(_rows(batch), batch["start"], strict=True):
            if at != (doc, chunk):
                at, state = (doc, chunk), Lists.from_json(start)
            state.row(key, level, fmt, is_break)
            if not is_break:
                out.append((doc, block, [{"value": v, "fmt": f} for v, f in state.parts(key, level)]))
        yield pd.DataFrame(out, columns=["doc_id", "block_idx", "parts"])
