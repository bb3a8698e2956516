"""The ordered fold of a document's blocks: gap-free places and running list numbers, chunk by chunk.

As in ``numbering``, what a chunk does to the state before it is a small summary; summaries are carried over, and every
chunk is then folded from the state it starts with. Rows are ``doc_id, chunk, block_idx, is_break, emits, counts,
list_key, list_level, num_fmt``, sorted by the first three; all other columns pass through Arrow untouched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa

from .numbering import Lists

PARTS = pa.list_(pa.struct([("value", pa.int64()), ("fmt", pa.string())]))
_READ = ("doc_id", "chunk", "is_break", "emits", "counts", "list_key", "list_level", "num_fmt")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in _READ), strict=True)


def _stored(place: int, lists: Lists) -> str:
    return json.dumps([place, lists.to_json()])


def _restored(text: str | None) -> tuple[int, Lists]:
    place, lists = json.loads(text) if text else (0, None)
    return place, Lists.from_json(lists)


def _take(lists: Lists, is_break: bool, counts: bool, key: str, level: int, fmt: str | None) -> None:
    if is_break or counts:
        lists.row(key, level, fmt, is_break)


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, chunk, summary)``: how many blocks a chunk emits and what it does to the lists."""
    at, place, lists, kind = None, 0, Lists(), None

    def told(rows: list[tuple]) -> pa.RecordBatch:
        docs, chunks, texts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(chunks, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "chunk", "summary"])

    for batch in batches:
        kind, done = batch.column("doc_id").type, []
        for doc, chunk, is_break, emits, counts, key, level, fmt in _rows(batch):
            if at != (doc, chunk):
                if at is not None:
                    done.append((*at, _stored(place, lists)))
                at, place, lists = (doc, chunk), 0, Lists()
            _take(lists, is_break, counts, key, level, fmt)
            place += emits
        yield told(done)
    if at is not None:
        yield told([(*at, _stored(place, lists))])


def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, chunk, start)`` from summaries sorted by document and chunk."""
    now, place, lists = None, 0, Lists()
    for batch in batches:
        starts = []
        for doc, summary in zip(batch.column("doc_id").to_pylist(), batch.column("summary").to_pylist(), strict=True):
            if now != (doc,):
                now, place, lists = (doc,), 0, Lists()
            starts.append(_stored(place, lists))
            more, later = _restored(summary)
            place, lists = place + more, lists.then(later)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chunk"), pa.array(starts, pa.string())], names=["doc_id", "chunk", "start"])


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that emit a block, with ``place`` and ``parts`` (the counters of a counted item)."""
    at, place, lists = None, 0, Lists()
    for batch in batches:
        keep, places, parts = [], [], []
        for (doc, chunk, is_break, emits, counts, key, level, fmt), start in zip(_rows(batch), batch.column("start").to_pylist(), strict=True):
            if at != (doc, chunk):
                at, (place, lists) = (doc, chunk), _restored(start)
            _take(lists, is_break, counts, key, level, fmt)
            keep.append(emits)
            if emits:
                places.append(place)
                parts.append([{"value": v, "fmt": f} for v, f in lists.parts(key, level)] if counts else None)
                place += 1
        kept = batch.filter(pa.array(keep, pa.bool_()))
        columns = [*kept.columns, pa.array(places, pa.int64()), pa.array(parts, PARTS)]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept.schema.names, "place", "parts"])
