"""Whole-column text kernels on the UTF-8 buffers that Arrow hands over.

No Python object is made per word.  A batch is cut into pieces of about
``PIECE_BYTES`` so that temporary arrays stay small; a text longer than that is a
piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import ship_by_value

PIECE_BYTES = 1 << 18
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_TABLES: dict[str, np.ndarray] = {}


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has length zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together take about ``size`` bytes."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _TABLES.get("pow")
    if have is None or len(have) < n:
        m = max(n, PIECE_BYTES * 2)
        up = np.full(m, _PRIME, np.uint64)
        down = np.full(m, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _TABLES["pow"], _TABLES["inv"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _TABLES["pow"][:n], _TABLES["inv"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any byte spans of one buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self._down = _powers(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sum[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sum[ends] - self._sum[starts]) * self._down[starts])


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero kind within a text: (starts, ends, row of each)."""
    n = len(kind)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    full = kind[starts] != 0
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def kind_table(**groups: bytes) -> np.ndarray:
    """Byte -> kind; the first group is kind 1, the rest follow; other bytes are 0."""
    out = np.zeros(256, np.uint8)
    for k, members in enumerate(groups.values(), 1):
        out[np.frombuffer(members, np.uint8)] = k
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of letters, digits and everything outside ASCII are words; the other printable ones are marks.
_LETTERS = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_MARKS = bytes(b for b in range(33, 127) if b not in _LETTERS)
WORD = kind_table(word=_LETTERS)
WORD_OR_MARK = kind_table(word=_LETTERS, mark=_MARKS)

ship_by_value(__name__)
