"""Words and word windows of many texts at once, as 64-bit hashes in NumPy arrays.

Runs inside tasks on Arrow batches. A word is a run of bytes other than white
space (U+0020 and U+0009 to U+000D).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

# Bytes of text looked at together: bounds the arrays of a task. A longer text is taken alone.
SLICE_BYTES = 250_000

_BYTE = np.random.RandomState(7).randint(0, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = {"": np.ones(1, dtype=np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> np.ndarray:
    if len(_powers[""]) < n:
        steps = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers[""] = np.multiply.accumulate(steps)
    return _powers[""]


@dataclass
class Words:
    """Words of the texts ``first`` to ``last`` (not included) of a batch."""

    first: int
    last: int
    data: np.ndarray  # bytes of the texts
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    bounds: np.ndarray  # words of text first + i: bounds[i] to bounds[i + 1]
    hashes: np.ndarray

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of ``size`` words from each word on, and whether these are in one text."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        hashes = window_hashes(self.hashes, size)
        counts = np.diff(self.bounds)
        left = np.repeat(self.bounds[1:], counts) - np.arange(n)
        return hashes, left >= size


def window_hashes(words: np.ndarray, size: int, base: np.uint64 = np.uint64(0xD6E8FEB86659FD93)) -> np.ndarray:
    """Polynomial hash of each ``size`` consecutive values, by doubling; the last ones hold fewer."""
    total = np.zeros(len(words), np.uint64)
    block, length, done, factor, block_factor = words.copy(), 1, 0, np.uint64(1), base
    with np.errstate(over="ignore"):
        while True:
            if size & length:
                total[: len(words) - done] += factor * block[done:]
                done += length
                factor = factor * block_factor
            if length * 2 > size:
                return mixed(total)
            shifted = np.zeros_like(block)
            shifted[:-length] = block[length:]
            block = block + block_factor * shifted
            block_factor = block_factor * block_factor
            length *= 2


# A-Z in lower case, ASCII punctuation as blanks.
PLAIN = np.array(
    [LOWER[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)], dtype=np.uint8
)


def text_words(column: pa.Array, table: np.ndarray | None = None) -> Iterator[Words]:
    """The words of a string or binary column without nulls, a slice at a time.

    ``table`` replaces each byte first, as ``LOWER`` and ``PLAIN`` do.
    """
    wide = column.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    content = column.buffers()[2]
    everything = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        data = everything[offsets[first] : offsets[last]]
        if table is not None:
            data = table[data]
        yield _split(first, last, data, offsets[first : last + 1] - offsets[first])
        first = last


def _split(first: int, last: int, data: np.ndarray, offsets: np.ndarray) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(first, last, data, none, none, np.zeros(last - first + 1, np.int64), none.astype(np.uint64))
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(first, last, data, starts, ends, bounds, np.zeros(0, np.uint64))
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    rest = data[starts[0] :]
    with np.errstate(over="ignore"):
        values = _BYTE[rest] * _power(int(lengths.max()))[place]
        values[~inside[starts[0] :]] = 0
        hashes = mixed(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(np.uint64))
    return Words(first, last, data, starts, ends, bounds, hashes)


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices ``begin[i]`` to ``begin[i] + sizes[i]`` (not included) for every i in turn."""
    stops = np.cumsum(sizes)
    return np.repeat(begin - stops + sizes, sizes) + np.arange(int(stops[-1]) if len(stops) else 0)
