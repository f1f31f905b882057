"""Words and shingles of many texts at once, as arrays over their UTF-8 bytes.

A column of texts arrives in a task as one Arrow buffer.  The functions here
work on slices of that buffer, so that the memory of a task follows the longest
text or a small budget, whichever is larger, and not the batch.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@lru_cache(1)
def _byte_values() -> np.ndarray:
    """A random odd 64-bit value for each byte, 0 for white space; A-Z get the values of a-z."""
    values = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    values[SPACE] = 0
    return values


BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(2)
def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE)
    down = np.full(n, BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES, 1 << max(0, n - 1).bit_length())
    up, down = _powers_to(size)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits (the finaliser of a well-known generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """A slice of a text column: its bytes and where each text begins; nulls are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> Words:
        return Words(self)


def slices(texts: pa.Array, budget: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a text column into slices of about ``budget`` bytes; a longer text is a slice of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if texts.null_count:  # the bytes under a null are undefined
        lengths = np.diff(offsets)
        if lengths[texts.is_null().to_numpy(zero_copy_only=False)].any():
            yield from slices(texts.fill_null(""), budget)
            return
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + budget, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield Texts(data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row], row)
        row = end


class Words:
    """Words of a slice: ``start`` and ``end`` in its bytes, and ``first[i]``, the first word of text i."""

    def __init__(self, texts: Texts):
        self.texts = texts
        data, offsets = texts.data, texts.offsets
        inside = ~SPACE[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(data))]
        begins[borders] |= inside[borders]
        ends[borders - 1] |= inside[borders - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words with A-Z lower-cased."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        data = self.texts.data
        up, down = _powers(len(data))
        sums = np.add.reduceat(_byte_values()[data] * up, self.start)
        return mix(sums * down[self.start] + (self.end - self.start).astype(np.uint64))


def shingles(words: Words, width: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its distinct shingles of ``width`` words, in order.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    h = words.hashes()
    n = len(h)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    run = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        run += h[k:n - width + 1 + k] * factors[k]
    run = mix(run)
    for i in range(len(words.first) - 1):
        lo, hi = words.first[i], words.first[i + 1]
        if hi - lo >= width:
            yield np.unique(run[lo:hi - width + 1])
        elif hi > lo:
            yield mix(np.array([(h[lo:hi] * factors[:hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
