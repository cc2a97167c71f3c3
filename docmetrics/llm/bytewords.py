"""Words of many texts at once, cut at bytes: texts as one buffer, words as numbers of distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def separators(characters: bytes) -> np.ndarray:
    """Which of the 256 bytes part words."""
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column laid end to end (null: empty), and where each text begins, with the end of the last."""
    whole = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions_of(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts have about ``size`` bytes together; a longer text is a portion of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        before, at = int(ends[to - 1]), to


def words_of(buf: np.ndarray, cuts: np.ndarray, parts: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The maximal stretches of bytes that do not part words, in order, and where in ``buf`` each begins. Words end with their text."""
    inside = ~parts[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = cuts[:-1][cuts[:-1] < len(buf)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    data = buf[inside]
    offsets = np.append(np.cumsum(inside)[starts] - 1, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), starts
