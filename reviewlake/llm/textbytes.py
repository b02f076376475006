"""Whole texts as byte arrays inside tasks: words, lines and window hashes in numpy.

A chunk holds the UTF-8 bytes of several whole texts end to end. Every helper
works on all texts of a chunk at once and never looks across a text's end. A
chunk is half a MB, or one text if that alone is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: What a task holds beside a chunk is up to 100 times as much, and a Python worker keeps
#: much of it afterwards, beside the executor's later stages.
CHUNK_BYTES = 1 << 19

#: Word separators of all contracts: space and 0x09-0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finishing steps of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def _power_store() -> dict:
    return {"n": 0, "up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base's first n powers and those of its inverse, modulo 2**64."""
    store = _power_store()
    if store["n"] < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            store[name] = np.cumprod(steps, dtype=np.uint64)
        store["n"] = size
    return store["up"][:n], store["down"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash of a sequence, one entry more than the sequence."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def byte_prefix_hash(data: np.ndarray) -> np.ndarray:
    return prefix_hash(_BYTE_VALUE[data])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of the hashed sequence."""
    down = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * down[start])


@dataclass
class Chunk:
    """Texts first..first+n of a column: their bytes end to end, and n+1 offsets."""

    first: int
    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value per byte."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[self.offs])

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i]:self.offs[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole texts; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield Chunk(at, data[offs[at]:offs[to]], (offs[at:to + 1] - offs[at]).astype(np.int64))
        at = to


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes within texts: starts, ends, and per text the
    index of its first run (n+1 entries)."""
    n = len(inside)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < n)]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, and per text the index of its first word."""
    return spans(~WHITE[chunk.data], chunk.offs)


def owners(bounds: np.ndarray) -> np.ndarray:
    """Which text each item belongs to, from the texts' item bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First items, and texts, of all windows of ``width`` items inside one text."""
    count = np.maximum(np.diff(bounds) - width + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    first = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][text]
    return first, text


def salted(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys made different for each text of a chunk."""
    return mix(key + mix(text.astype(np.uint64) + np.uint64(1)))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct 64-bit keys, the first place of each, and each key's number.

    What ``np.unique`` gives, by sorting the keys' high bits with the places below
    them; keys that differ in the low bits only send it back to ``np.unique``.
    """
    n = len(keys)
    low = np.uint64(max(n, 1).bit_length())
    order = np.sort((keys >> low << low) | np.arange(n, dtype=np.uint64))
    order = (order & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    every = keys[order]
    new = np.ones(n, bool)
    new[1:] = every[1:] != every[:-1]
    if np.any(new[1:] & (every[1:] >> low == every[:-1] >> low)):
        return np.unique(keys, return_index=True, return_inverse=True)
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    return every[new], order[new], number
