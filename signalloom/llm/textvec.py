"""Words, lines and their hashes of whole columns of texts, as arrays.

All of it works on the UTF-8 bytes of an Arrow column: words are separated by ASCII
blanks, which never occur inside a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from signalloom.llm.tables import BLANKS

# Bytes of text that are worked on at once, and whose powers are kept.
BLOCK = 1 << 20

IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[ord(c) for c in BLANKS]] = True

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, and 5 modulo 8
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, dtype=np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


_UP, _DOWN = _powers(_P, BLOCK + 1), _powers(_P_INVERSE, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit integers over all bits of the result (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``size`` bytes; a row stays whole."""
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; spans ascend and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        n = int(ends[j - 1] - base)
        up, down = (_UP, _DOWN) if n <= BLOCK else (_powers(_P, n + 1), _powers(_P_INVERSE, n + 1))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data[base : base + n]] * up[:n], out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


@dataclass
class Words:
    """The words of a block: byte spans, the row each belongs to, and hashes."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~IS_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    return Words(starts, ends, row, span_hashes(data, starts, ends))


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the runs of ``n`` words that lie in one row."""
    count = len(w.hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    factor = 1
    for k in range(n):
        total += w.hashes[k : k + count] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    first = np.flatnonzero(w.row[:count] == w.row[n - 1 :])
    return first, mix(total[first])


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row's bytes."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def with_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows."""
    return mix(hashes + row.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
