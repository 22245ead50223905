"""Word shingles as 64-bit hashes, computed with numpy over Arrow text columns.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z is lower-cased.
A text's shingles are its distinct runs of ``width`` words; a shorter text has its
whole word sequence as its one shingle; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2, _M3 = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)], dtype=np.uint64)

# Bytes of text hashed at once: bounds the arrays made from a batch.
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, off


def chunks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges whose text is about CHUNK_BYTES together (one row at least)."""
    start, n = 0, len(off) - 1
    while start < n:
        stop = int(np.searchsorted(off, off[start] + CHUNK_BYTES, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of rows whose text lies at ``off`` in ``raw``."""
    base, size = int(off[0]), int(off[-1] - off[0])
    if size == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    low = np.zeros(size + 8, dtype=np.uint8)
    low[:size] = _LOWER[raw[base:base + size]]
    word = _WORD[low[:size]]
    rows = np.flatnonzero(np.diff(off) > 0)
    first, last = off[rows] - base, off[rows + 1] - base - 1
    edge = word.copy()
    edge[1:] &= ~word[:-1]
    edge[first] = word[first]
    starts = np.flatnonzero(edge)
    edge = word.copy()
    edge[:-1] &= ~word[1:]
    edge[last] = word[last]
    length = np.flatnonzero(edge) + 1 - starts
    eight = np.ndarray((size + 1,), dtype="<u8", buffer=low.data, strides=(1,))
    h = length.astype(np.uint64) * _M1
    live, at = np.arange(len(starts)), 0
    while len(live):
        left = length[live] - at
        x = eight[starts[live] + at]
        short = left < 8
        x[short] &= _TAIL[left[short]]
        h[live] = mix((h[live] ^ x) * _M1 + _M3)
        live, at = live[left > 8], at + 8
    return h, np.searchsorted(off[1:] - base, starts, side="right")


def ngram_hashes(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``width`` words, or of a shorter row's whole sequence; in row order."""
    n = len(h)
    if n == 0:
        return h, row
    out_h, out_row = [], []
    if n >= width:
        keep = np.flatnonzero(row[width - 1:] == row[:n - width + 1])
        g = np.zeros(len(keep), np.uint64)
        for j in range(width):
            g = g * _M1 + h[keep + j]
        out_h.append(mix(g + np.uint64(width)))
        out_row.append(row[keep])
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[heads, n])
    for k in range(1, width):
        at = heads[count == k]
        if len(at):
            g = np.zeros(len(at), np.uint64)
            for j in range(k):
                g = g * _M1 + h[at + j]
            out_h.append(mix(g + np.uint64(k)))
            out_row.append(row[at])
    g, r = np.concatenate(out_h), np.concatenate(out_row)
    if len(out_h) > 1:
        order = np.argsort(r, kind="stable")
        g, r = g[order], r[order]
    return g, r


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for row ranges of a text column."""
    raw, off = text_buffers(column)
    for start, stop in chunks(off):
        g, row = ngram_hashes(*word_hashes(raw, off[start:stop + 1]), width)
        cut = np.searchsorted(row, np.arange(stop - start + 1))
        yield start, [np.unique(g[cut[i]:cut[i + 1]]) for i in range(stop - start)]
