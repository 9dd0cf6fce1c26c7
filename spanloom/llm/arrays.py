"""Whole texts as numpy arrays: words, hashes and shingles of an Arrow batch without a Python loop per word.

A task works on runs of rows of about ``CHUNK_BYTES``, so its memory follows the longest single text and not the batch.
Hashes are 64 bits wide: word = polynomial over its bytes, mixed; shingle = weighted sum of five word hashes, mixed.
"""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U
)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_powers = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _grown(base, n):
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power_tables(n):
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers[:] = [_grown(_BASE, size), _grown(_BASE_INVERSE, size)]
    return _powers


def mix(x):
    """Bijective finisher on 64-bit words: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def give_back():
    """Returns memory that was freed to the system: workers live on between tasks, next to an executor's own needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(function):
    """Wraps a function over batches so that its task gives memory back at its end."""
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def as_long(x):
    return np.ascontiguousarray(x, dtype=U).view(np.int64)


def as_hash(x):
    return np.ascontiguousarray(x, dtype=np.int64).view(U)


def text_chunks(column, limit=CHUNK_BYTES):
    """(first row, last row, bytes, row offsets) of successive runs of rows; null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(inside, offsets):
    """Start, end and row of every maximal run of true bytes that does not cross a row."""
    if not len(inside):
        return (np.zeros(0, dtype=np.int64),) * 3
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data, start, end):
    """64-bit hash of every byte span."""
    if not len(start):
        return np.zeros(0, dtype=U)
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))


def word_hashes(data, offsets):
    """(hash, row) of every word: runs of bytes other than blanks, A-Z lower-cased."""
    start, end, row = runs(~BLANK[data], offsets)
    return span_hashes(LOWER[data], start, end), row


def shingle_sets(data, offsets, width=5):
    """Per row the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words gives one element, the whole sequence; a text without words gives none.
    """
    words, row = word_hashes(data, offsets)
    rows = len(offsets) - 1
    bounds = np.searchsorted(row, np.arange(rows + 1))
    count = max(len(words) - width + 1, 0)
    flat = np.zeros(count, dtype=U)
    for i in range(width):
        flat += words[i : i + count] * (_STEPS[i % len(_STEPS)] + U(2 * (i // len(_STEPS))))
    flat = mix(flat)
    out = []
    for r in range(rows):
        a, b = bounds[r], bounds[r + 1]
        if b - a >= width:
            out.append(np.unique(flat[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=U)
            for w in words[a:b]:
                whole = mix(whole * _STEPS[0] + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=U))
    return out
