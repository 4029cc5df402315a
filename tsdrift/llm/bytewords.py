"""Words of many texts at once, found on their bytes as NumPy arrays.

A text is UTF-8, so a byte class that treats all bytes above 0x7F alike splits it
exactly as the class of code points does.  Used inside Arrow tasks only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR, BREAK = 1, 2


def byte_table(separators: bytes, breaks: bytes = b"") -> np.ndarray:
    """Kind of every byte: 0 in a word, ``SEPARATOR`` or ``BREAK`` (a separator
    that also ends a piece)."""
    out = np.zeros(256, np.uint8)
    out[list(separators)] = SEPARATOR
    if breaks:
        out[list(breaks)] = BREAK
    return out


def byte_ranges(*ranges: tuple[int, int]) -> bytes:
    return bytes(b for lo, hi in ranges for b in range(lo, hi + 1))


def slices(batches: Iterable[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that their texts hold ``limit`` bytes at most
    (or one longer text); null texts become empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(text).cast(pa.string()), "")
        batch = batch.set_column(text, batch.schema.names[text], texts)
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def gathered(batches: Iterable[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.Table]:
    """Neighbouring slices joined to tables of about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in slices(batches, text, limit):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def split(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, text, piece): all words of ``texts`` (strings without nulls) in
    order, A-Z in lower case; the number of the text each is from; and the
    number of its piece, which no two texts share."""
    texts = pc.ascii_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets -= offsets[0]
    kind = table[data]
    inside = kind == 0
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True  # the first byte of a text (or of the next one that has any)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts |= inside & begins[:-1]
    at = np.flatnonzero(starts)
    piece = np.cumsum((kind == BREAK) | begins[:-1], dtype=np.int32)[at].astype(np.int64)
    edges = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, int(inside.sum())).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(edges), pa.py_buffer(data[inside]))
    return words, np.searchsorted(offsets, at, side="right") - 1, piece
