"""Vectorised hashes of words and of runs of words, on Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
STEP = U(0xD6E8FEB86659FD93)
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mixed((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
BYTES_LOWER = BYTES.copy()
BYTES_LOWER[65:91] = BYTES[97:123]  # A-Z as a-z

_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and its inverses modulo 2**64, for i below ``n``."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK) + 1, base, dtype=U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Words of consecutive texts: ``first[i]:first[i + 1]`` are those of text ``row + i``."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    text_starts: np.ndarray

    def text_end(self) -> np.ndarray:
        """For each word, the index after its text's last word."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``k`` words from each word on, and whether the text holds that many."""
        n = len(self.hashes)
        out = np.zeros(n, dtype=U)
        if n >= k:
            g = np.zeros(n - k + 1, dtype=U)
            for j in range(k):
                g *= STEP
                g += self.hashes[j : n - k + 1 + j]
            out[: n - k + 1] = mixed(g)
        return out, np.arange(n) + k <= self.text_end()


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def word_chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK) -> Iterator[Words]:
    """Hash the words of all texts, about ``limit`` bytes at a time (a longer text goes alone, whole)."""
    data, offsets = texts_of(column)
    row, rows = 0, len(column)
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield _hashed(row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row], lower)
        row = last


def _hashed(row: int, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(row, data, none, none, np.zeros(0, dtype=U), np.zeros(len(offsets), dtype=np.int64), offsets)
    inner = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0], before[1:] = False, inner[:-1]
    before[edge[:n]] = False
    after[-1], after[:-1] = False, inner[1:]
    after[edge[1:]] = False
    starts, ends = np.flatnonzero(inner & ~before), np.flatnonzero(inner & ~after) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum((BYTES_LOWER if lower else BYTES)[data] * up, out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    return Words(row, data, starts, ends, hashes, np.searchsorted(starts, offsets), offsets)
