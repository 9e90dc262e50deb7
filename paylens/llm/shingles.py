"""Word shingles of whole Arrow batches with numpy.

A batch's texts lie end to end in one buffer; words, their hashes and the shingles'
hashes are computed over the buffer at once, without a Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# ---- fixed values: odd multipliers of the hashes ----
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

SLICE_BYTES = 1 << 21
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column's texts, end to end; nulls are empty."""
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word in order, number of words per text). Words are runs
    without ASCII white space, with A-Z in lower case; a text's end ends a word."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = LOWER[data]
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~IS_SPACE[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    edge = at[:-1][at[:-1] < n]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    stops = ~inside[1:]
    stops[edge[edge > 0] - 1] = True
    sizes = np.flatnonzero(stops & inside[:n]) + 1 - starts
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    hashes = sizes.astype(np.uint64) * np.uint64(WORD_BASE)
    live, place, left = slice(None), starts, sizes
    while len(left):
        hashes[live] = mix((hashes[live] ^ (eight[place] & FIRST_BYTES[np.minimum(left, 8)])) + np.uint64(BYTE_BASE))
        longer = np.flatnonzero(left > 8)
        live = longer if isinstance(live, slice) else live[longer]
        place, left = place[longer] + 8, left[longer] - 8
    return hashes, np.diff(np.searchsorted(starts, at))


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted 64-bit hashes of its distinct shingles of ``size`` words. A
    text of fewer words has its whole sequence as one shingle; one without words none."""
    data, at = text_buffer(column)
    power = _powers(WORD_BASE, size)
    first = 0
    while first < len(at) - 1:
        # some megabytes of whole texts at a time
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        part = at[first : last + 1]
        hashes, counts = words(data[part[0] : part[-1]], part - part[0])
        grams = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for i in range(size):
            grams += hashes[i : i + len(grams)] * power[i]
        grams = mix(grams + np.uint64(size))
        begin = 0
        for count in counts.tolist():
            if count >= size:
                yield np.unique(grams[begin : begin + count - size + 1])
            elif count:
                short = (hashes[begin : begin + count] * power[:count]).sum(dtype=np.uint64)
                yield mix(np.array([short + np.uint64(count)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            begin += count
        first = last
