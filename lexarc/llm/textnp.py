"""Whole texts as byte arrays: words, lines and their hashes for a slice of an Arrow column at once.

Words are runs of bytes outside ``\\x20\\x09-\\x0D``; UTF-8 never uses those bytes inside a longer
character, so the byte view and the character view give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
SLICE_BYTES = 1 << 18


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, SLICE_BYTES), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer text gets a range of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64) + 1)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return pc.cast(batch.column(batch.schema.get_field_index(name)), pa.large_string())


class Texts:
    """Texts back to back with a newline before, between and after them; a null text is empty."""

    def __init__(self, column: pa.Array, table: np.ndarray | None = None):
        column = pc.fill_null(pc.cast(column, pa.large_string()), "")
        n = len(column)
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if n and column.buffers()[2] else np.zeros(0, np.uint8)
        edges = bounds - bounds[0] + np.arange(n + 1)
        self.data = np.empty(len(raw) + n + 1, np.uint8)
        body = np.ones(len(self.data), bool)
        body[edges] = False
        self.data[body] = raw if table is None else table[raw]
        self.data[edges] = 10
        self.n, self.starts, self.ends = n, edges[:-1] + 1, edges[1:]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word, in order."""
        space = SPACE[self.data]
        turn = np.flatnonzero(space[1:] != space[:-1]) + 1
        return turn[::2], turn[1::2]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every line, split at newlines only; an empty text has one empty line."""
        at = np.flatnonzero(self.data == 10)
        return at[:-1] + 1, at[1:]

    def split_by_text(self, starts: np.ndarray) -> np.ndarray:
        """n + 1 bounds: where each text's items begin in the sorted ``starts``."""
        return np.append(np.searchsorted(starts, self.starts), len(starts))

    def prefix(self) -> np.ndarray:
        """Running polynomial hash, one longer than the data."""
        h = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_CODES[self.data] * _power("up", len(self.data)), out=h[1:])
        return h

    def hashes(self, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        h = self.prefix() if prefix is None else prefix
        down = _power("down", len(self.data) + 1)
        return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the items of each text."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` consecutive items."""
    out = h[: max(0, len(h) - k + 1)].copy()
    for i in range(1, k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + len(out)])
    return out


class HashTable:
    """Open addressing over distinct 64-bit keys; a lookup of a whole array takes a few passes."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.index = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo, step = np.arange(len(keys), dtype=np.int32), 0
        home = self._home(keys)
        while len(todo):
            slot = (home[todo] + step) & self.mask
            free = self.index[slot] < 0
            self.index[slot[free]] = todo[free]  # of several, the last written stays
            won = self.index[slot] == todo
            self.keys[slot[won]] = keys[todo[won]]
            todo, step = todo[~won], step + 1
        self.probes = max(1, step)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        slot = self._home(keys)
        at = self.index[slot]
        found = np.where(self.keys[slot] == keys, at, -1)
        todo = np.flatnonzero((found < 0) & (at >= 0))
        for step in range(1, self.probes):
            if not len(todo):
                break
            slot = (self._home(keys[todo]) + step) & self.mask
            at = self.index[slot]
            hit = (at >= 0) & (self.keys[slot] == keys[todo])
            found[todo[hit]] = at[hit]
            todo = todo[(at >= 0) & ~hit]
        return found
