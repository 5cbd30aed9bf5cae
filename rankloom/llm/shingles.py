"""Hashed word shingles of whole texts, computed on Arrow buffers with numpy.

Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased. A word's
hash is a polynomial over its bytes; a shingle's is a mix of its words' hashes; all are 63 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes hashed at once: bounds the working memory, also in one very long text
_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _segments(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(raw: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the words of one text given as bytes, in order."""
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8) if lower else raw
    starts, ends = _segments((low == 32) | ((low >= 9) & (low <= 13)))
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # as many whole words as fit into a chunk
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        lo, hi = int(starts[at]), int(ends[upto - 1])
        if hi - lo > CHUNK:  # one word longer than a chunk: hash its chunks, then them
            parts = [word_hashes_of(low[k : min(k + CHUNK, hi)]) for k in range(lo, hi, CHUNK)]
            out[at] = _mix(np.asarray(parts, np.uint64) * _UP[1 : len(parts) + 1]).sum(dtype=np.uint64)
        else:
            total = np.concatenate(([_U(0)], np.cumsum(_BYTE[low[lo:hi]] * _UP[: hi - lo], dtype=np.uint64)))
            s, e = starts[at:upto] - lo, ends[at:upto] - lo
            out[at:upto] = (total[e] - total[s]) * _DOWN[s] + (e - s).astype(np.uint64)
        at = upto
    return _mix(out)


def word_hashes_of(chunk: np.ndarray) -> int:
    return int((_BYTE[chunk] * _UP[: len(chunk)]).sum(dtype=np.uint64))


def shingle_set(raw: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes (int64, not negative) of the runs of ``words`` words.

    A text of fewer words has one: its whole sequence. Without words there are none.
    """
    w = word_hashes(raw)
    if len(w) == 0:
        return np.empty(0, np.int64)
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mix(h * _U(0x2545F4914F6CDD1D) + w[k : len(w) - size + 1 + k])
    return np.unique((h >> _U(1)).astype(np.int64))


def sets_of(column: pa.Array, words: int):
    """The shingle sets of an Arrow string column, one by one; null counts as empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, at, data = column.buffers()
    at = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    for k in range(len(column)):
        yield shingle_set(raw[at[k] : at[k + 1]], words) if column[k].is_valid else np.empty(0, np.int64)
