"""Windows of bytes: hashes of runs of a text's UTF-8 bytes, and which of them a table holds.

A text contains a pattern only if it shows, byte by byte, every window of it. A window's hash
is a polynomial over 64 bits, so that one of length a + b comes of two shorter ones, and all
windows of a batch of texts come of a few passes over its bytes. Equal hashes of different
windows are let through: who uses them looks again.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors get this module with the plan: they need numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Lengths of windows; a pattern takes the longest that fits it.
LENGTHS = (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32)
# Windows of a pattern that are weighed against each other; at most so many if they stand densely.
TRIED, _DENSE = 8, 256
# Windows looked at in one pass: its arrays fit into a core's cache.
_PASS = 1 << 15
# Keys a held table is built of at a time, slots (bytes) of its first look, and the bits a key
# gets, and a table may have, for the second: 4 + 32 MB for each length at most.
KEYS_AT_ONCE = 1_000_000
_MAX_SLOTS = 1 << 22
_BITS_PER_KEY = 32
_MAX_BITS = 1 << 28
_PLACES = 4

_SPLIT = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4)}
_SPLIT |= {12: (8, 4), 16: (8, 8), 24: (16, 8), 32: (16, 16)}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_POWER = {n: np.uint64(pow(_BASE, n, 1 << 64)) for n in LENGTHS}
_BIT = np.left_shift(1, np.arange(8)).astype(np.uint8)
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class Held(NamedTuple):
    """Which hashes a set may hold: passes all of them and, by its size, few others."""

    first: np.ndarray
    bits: np.ndarray

    @classmethod
    def empty(cls, n: int) -> Held:
        size = 1 << max(10, (n * _BITS_PER_KEY - 1).bit_length())
        return cls(
            np.zeros(min(size, _MAX_SLOTS), bool), np.zeros(min(size, _MAX_BITS) // 8, np.uint8)
        )

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.first).bit_length())).view(np.int64)

    def _places(self, h: np.ndarray):
        h = _mixed(h)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(_PLACES):
            at = (h + np.uint64(i) * step) & np.uint64(len(self.bits) * 8 - 1)
            yield (at >> np.uint64(3)).view(np.int64), _BIT[(at & np.uint64(7)).view(np.int64)]

    def add(self, h: np.ndarray) -> None:
        self.first[self._slots(h)] = True
        for at, bit in self._places(h):
            np.bitwise_or.at(self.bits, at, bit)

    def passed(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that pass."""
        found = np.flatnonzero(self.first.take(self._slots(h)))
        some = h[found]
        passes = np.ones(len(some), bool)
        for at, bit in self._places(some):
            passes &= (self.bits[at] & bit) != 0
        return found[passes]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each string starts and ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    ends = ends.astype(np.int64)
    size = ends[-1] - ends[0]
    data = np.frombuffer(data, np.uint8, size, ends[0]) if size else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _hashes(data: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length the hash of every window of the bytes."""
    needed = {1, *lengths}
    for n in reversed(LENGTHS):
        if n in needed:
            needed.update(_SPLIT.get(n, ()))
    made = {1: _BYTES[data]}
    for n in sorted(needed - {1}):
        a, b = _SPLIT[n]
        count = max(0, len(data) - n + 1)
        made[n] = made[a][:count] * _POWER[b] + made[b][a : a + count]
    return {n: made[n] for n in lengths}


def _once(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of row and key once."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def shown(column: pa.Array, lengths: list[int], held: dict[int, Held] | None):
    """(rows, keys) of the windows that the texts show and ``held`` lets pass, part by part;
    each once in a part."""
    data, ends = _bytes(column)
    rows, keys, n_found = [], [], 0
    for start in range(0, len(data), _PASS):
        made = _hashes(data[start : start + _PASS + max(lengths, default=1) - 1], lengths)
        for n, h in made.items():
            h = h[:_PASS]
            found = held[n].passed(h) if held is not None else np.arange(len(h))
            row = np.searchsorted(ends, found + start, "right") - 1
            inside = found + start + n <= ends[row + 1]
            rows.append(row[inside])
            keys.append(h[found[inside]])
            n_found += len(rows[-1])
        if n_found > _PASS or n_found and start + _PASS >= len(data):
            yield _once(np.concatenate(rows), np.concatenate(keys))
            rows, keys, n_found = [], [], 0


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], [*columns])


def text_batches(lengths: list[int], held=None):
    """For mapInArrow: from (_digest, _text) to (_digest, key); all pass if nothing is held.

    ``held``: a broadcast of the parts of a ``Held`` for each length.
    """

    def made(batches):
        tables = None
        if held is not None:
            tables = {n: Held(*parts) for n, parts in held.value.items()}
        for batch in batches:
            digest = batch.column("_digest").to_numpy(zero_copy_only=False)
            for rows, keys in shown(batch.column("_text"), lengths, tables):
                yield _batch(_digest=digest[rows], key=keys.view(np.int64))

    return made


def pattern_batches(dense: bool = False):
    """For mapInArrow: from (pid, pattern) to (pid, length, key), even windows of each pattern.

    ``dense``: each byte is in two windows or more (of a pattern of up to 4,000 bytes), so that
    patterns that differ in a word differ in a window.
    """

    def made(batches):
        for batch in batches:
            pid = batch.column("pid").to_numpy(zero_copy_only=False)
            data, ends = _bytes(batch.column("pattern"))
            sizes = np.diff(ends)
            longest = np.searchsorted(LENGTHS, sizes, "right") - 1
            for k in np.unique(longest):
                n, own = LENGTHS[k], np.flatnonzero(longest == k)
                room = sizes[own] - n
                tried = np.full(len(own), TRIED)
                if dense:
                    tried = np.clip(room // max(1, n // 2) + 2, TRIED, _DENSE)
                rows = np.repeat(np.arange(len(own)), tried)
                nth = np.arange(len(rows)) - np.repeat(np.cumsum(tried) - tried, tried)
                starts = ends[own][rows] + room[rows] * nth // (tried[rows] - 1)
                h = np.zeros(len(starts), np.uint64)
                for i in range(n):
                    h = h * np.uint64(_BASE) + _BYTES[data[starts + i]]
                rows, keys = _once(own[rows], h)
                length = np.full(len(rows), n, np.int32)
                yield _batch(pid=pid[rows], length=length, key=keys.view(np.int64))

    return made
