"""64-bit codes of the words in a batch of texts, worked out for all bytes at once.

Used inside Arrow functions. A word's code is a polynomial of its bytes modulo 2 ** 64, taken from running sums, mixed
with its length; equal words have equal codes, different words differ but for chance (about 2 ** -64 a pair).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer text is a block of its own. A byte takes some fifty bytes of numbers meanwhile.
BLOCK_BYTES = 1 << 18
#: Rows of an Arrow batch that become Python objects, or a batch of results, at once.
PIECE_ROWS = 512
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)

_is_space = np.zeros(256, bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into such of at most that many rows, without copying; none for an empty one."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_blocks(column: pa.Array, block: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts as (first row, last row + 1, bytes, offsets of the texts in them); NULL is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
        yield at, end, data[offsets[at]: offsets[end]], offsets[at: end + 1] - offsets[at]
        at = end


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it (one more at the end)."""
    inside = ~_is_space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool = True) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_lower[data] if lower else data).astype(np.uint64) * power[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """A code for each k words in a row, in order."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = codes[:n]
    for j in range(1, k):
        g = mix(g * np.uint64(0xA0761D6478BD642F) + codes[j: j + n])
    return g
