"""Vectorised byte kernels: words, lines and their 64-bit hashes straight from Arrow buffers.

A run's hash is a polynomial over a random value for each byte, modulo 2**64, taken
from prefix sums, so a whole batch is hashed without a Python loop over words. A-Z
count as a-z. Hashes depend on the bytes alone, not on the place or the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(seed: int, fold: bool = True) -> np.ndarray:
    """A random value for each byte; A-Z have those of a-z where case is folded."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(seed))
    if fold:
        values[65:91] = values[97:123]
    return values


#: Kinds of hashes: two that fold case, and one that keeps it.
VALUES = (_byte_values(1), _byte_values(2), _byte_values(3, fold=False))
KEEP_CASE = 2
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words between white space, and words of letters, digits and what is not ASCII.
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Bytes hashed at a time: it bounds the tables of powers and the arrays beside them, whatever the length of a text.
SEGMENT = 1 << 17


def _powers(base: np.uint64) -> np.ndarray:
    table = np.full(2 * SEGMENT + 1, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


_POWER, _INVERSE = _powers(_ODD), _powers(_ODD_INVERSE)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hashes of data[start:end] for each run; starts ascend, runs may be empty and may overlap."""
    out = np.empty(len(starts), np.uint64)
    values, at = VALUES[kind], 0
    while at < len(starts):
        base = int(starts[at])
        last = int(np.searchsorted(starts, base + SEGMENT, "left"))
        s, e = starts[at:last] - base, ends[at:last] - base
        long = np.flatnonzero(e > 2 * SEGMENT)
        if len(long):
            for k in long.tolist():
                out[at + k] = _long_run(data[base + int(s[k]) : base + int(e[k])], values)
            e = np.where(e > 2 * SEGMENT, s, e)
        n = int(e.max())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data[base : base + n]] * _POWER[:n], out=sums[1:])
        found = (sums[e] - sums[s]) * _INVERSE[s]
        if len(long):
            found[long] = out[at:last][long]
        out[at:last] = found
        at = last
    return mix(out + (ends - starts).astype(np.uint64) * _ODD)


def _long_run(run: np.ndarray, values: np.ndarray) -> np.uint64:
    total, step = 0, int(pow(int(_ODD), SEGMENT, 1 << 64))
    for k in range(-(-len(run) // SEGMENT) - 1, -1, -1):
        part = run[k * SEGMENT : (k + 1) * SEGMENT]
        total = (total * step + int((values[part] * _POWER[: len(part)]).sum(dtype=np.uint64))) % (1 << 64)
    return np.uint64(total)


def text_chunks(column: pa.Array, limit: int = 1 << 20):
    """Slices of a text column: (first row, bytes, offsets), about limit bytes each unless one text is longer.

    A null text has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        last = min(last, len(column))
        part = offsets[row : last + 1]
        yield row, data[part[0] : part[-1]], part - part[0]
        row = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more at the end).

    A word never spans two texts.
    """
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines between newlines, and the index of each text's first line; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    per_text = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    index = np.zeros(len(offsets), np.int64)
    np.cumsum(per_text, out=index[1:])
    starts, ends = np.empty(index[-1], np.int64), np.empty(index[-1], np.int64)
    is_first, is_last = np.zeros(index[-1], bool), np.zeros(index[-1], bool)
    is_first[index[:-1]] = True
    is_last[index[1:] - 1] = True
    starts[is_first], starts[~is_first] = offsets[:-1], breaks + 1
    ends[is_last], ends[~is_last] = offsets[1:], breaks
    return starts, ends, index


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of width consecutive word hashes (texts not told apart)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= _ODD
        total += hashes[k : k + n]
    return mix(total)
