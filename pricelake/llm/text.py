"""Array helpers over the bytes of many texts at once, used inside Arrow tasks.

Texts of a batch lie behind one another in one byte array; the helpers work on blocks
of a few megabytes of it, so a task's memory does not depend on the batch size. Words
are runs of bytes other than ASCII spaces (0x20, 0x09-0x0D), which never cut a UTF-8
character. All hashes are 64-bit and wrap around.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
SMALL_BLOCK_BYTES = 512 << 10  # where a task needs a dozen 64-bit arrays as long as its block
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

class _Powers:
    """The hash base and its inverse to the powers 0..n-1, kept per process.

    The tables are megabytes, as long as the longest block so far; a task's copy of the functions comes without them.
    """

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return type(self), ()

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = n if n <= 4096 else -(-n >> 18) << 18
            self.up, self.down = (self._table(base, size) for base in (_BASE, _BACK))
        return self.up, self.down

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        table = np.full(size, base, np.uint64)
        table[0] = 1
        return np.multiply.accumulate(table)


_POWERS = _Powers()


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Running polynomial hash of 64-bit codes; entry i covers the first i."""
    up, _ = _POWERS.tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end), the same wherever the content stands."""
    _, down = _POWERS.tables(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


class Block(NamedTuple):
    batch: pa.RecordBatch
    first: int  # rows [first, last) of the batch
    last: int
    data: np.ndarray  # their bytes
    ends: np.ndarray  # row i has bytes ends[i]:ends[i + 1]


def blocks(batches: Iterable[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts, at least one each; a null text is empty."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if values.null_count:
            values = pc.fill_null(values, b"" if pa.types.is_binary(values.type) else "")
        wide = pa.large_binary() if pa.types.is_binary(values.type) else pa.large_string()
        values = values.cast(wide)
        n = len(values)
        if not n:
            continue
        _, offsets, data = values.buffers()
        ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = int(np.searchsorted(ends, ends[first] + size, side="right")) - 1
            last = min(n, max(first + 1, last))
            yield Block(batch, first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
            first = last


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and `bounds`: row i has words bounds[i]:bounds[i + 1]."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    np.logical_not(IS_SPACE[data], out=solid[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    begins = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    stops = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    return begins, stops, np.searchsorted(begins, ends)


def pieces(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Binary array of the spans; spans may lie anywhere in `values`."""
    lengths = stops - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    index = np.arange(offsets[-1], dtype=np.int64) + np.repeat(starts - offsets[:-1], lengths)
    out = values[index]
    return pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
