"""Text columns of Arrow batches as numpy arrays: bytes, words and their digests.

Everything here works on a slice of a batch that holds a bounded number of text bytes, so a task's
memory depends on the slice and its longest text, not on its partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SLICE_ROWS = 1 << 13

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64
_POWERS = np.ones(1, dtype=_U)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about ``most`` bytes of text and at most ``SLICE_ROWS``
    rows, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        cut = np.diff(piece, prepend=-1) > 0
        cut[::SLICE_ROWS] = True
        starts = np.flatnonzero(cut)
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(start), int(end - start))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and where each text starts (one more at the end).

    Null counts as empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)
    offsets = offsets[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    if data is None or len(filled) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(filled) + 1, dtype=np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return body, offsets - offsets[0]


def word_bounds(is_word: np.ndarray, starts_of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes; a run never crosses the start of a text."""
    if len(is_word) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cut = np.zeros(len(is_word) + 1, dtype=bool)
    cut[starts_of_text] = True
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | cut[1:-1]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1 << 12), _BASE, dtype=_U)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=_U)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U))


def word_digests(
    body: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER
) -> np.ndarray:
    """A 64-bit digest of each word after ``fold`` (byte to byte)."""
    if len(begins) == 0:
        return np.zeros(0, dtype=_U)
    lengths = ends - begins
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()), dtype=np.int64)
    inside = at - np.repeat(first, lengths)
    values = _BYTE_VALUES[fold][body[at + np.repeat(begins - first, lengths)]]
    values *= powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(values, first) + lengths.astype(_U))


def chain_digests(words: np.ndarray, size: int) -> np.ndarray:
    """A digest of each ``size`` words in a row, by the place of the first."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    h = words[:n].copy()
    for k in range(1, size):
        h *= _U(_BASE)
        h += words[k : k + n]
    return mix(h + _U(size))


def of_texts(begins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the words of each text start in the list of words (one more at the end)."""
    return np.searchsorted(begins, starts)
