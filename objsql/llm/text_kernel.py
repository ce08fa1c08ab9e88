"""Vectorised work on Arrow string columns: word and line spans, hashes, counts.

Everything here works on the UTF-8 buffer of a column with numpy, so the cost
per byte is a few array passes and no Python object is made for a word. Texts
are taken in runs of about ``RUN_BYTES`` so that the scratch arrays stay
bounded whatever the size of an Arrow batch; a longer text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

#: The white space of the query contracts: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and every other ASCII character that is neither letter nor digit.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, RUN_BYTES + 1)
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Run:
    """Some consecutive texts of a column: their bytes and where each begins."""

    __slots__ = ("first", "data", "bounds", "_prefix")

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds, self._prefix = first, data, bounds, None

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def spans(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text number of each longest stretch without separators."""
        inside = np.zeros(len(self.data) + 1, bool)
        inside[:-1] = ~separators[self.data]
        before = np.zeros(len(self.data) + 1, bool)
        before[1:] = inside[:-1]
        edges = self.bounds[1:-1]
        # A stretch also ends where a text ends.
        cut = np.zeros(len(self.data) + 1, bool)
        cut[edges] = True
        starts = np.flatnonzero(inside & (~before | cut))
        ends = np.flatnonzero(before & (~inside | cut))
        return starts, ends, np.searchsorted(self.bounds, starts, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text number of each \\n-split line; a text has one at least."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.bounds[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.bounds[1:], breaks]), kind="stable")
        owner = np.sort(np.concatenate([np.arange(len(self)), np.searchsorted(self.bounds, breaks, "right") - 1]), kind="stable")
        return starts, ends, owner

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes."""
        up, down = _power_table(len(self.data) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE_CODES[self.data] * up[: len(self.data)], out=self._prefix[1:])
        return mix((self._prefix[ends] - self._prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def count(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(marked, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def runs(column: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[Run]:
    """The texts of a string column in order; null counts as empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + run_bytes, "right")) - 1)
        yield Run(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def combine(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``width`` consecutive items of one owner, and where each begins."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = np.flatnonzero(owner[:n] == owner[width - 1 :])
    out = hashes[begins].copy()
    for k in range(1, width):
        out = mix(out * _MULTIPLIER + hashes[begins + k])
    return out, begins


def sequence_hashes(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """One hash for each stretch of items, firsts[i] to firsts[i + 1]; 0 for an empty one, equal for equal stretches."""
    up, down = _power_table(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    n = np.diff(firsts)
    out = mix((total[firsts[1:]] - total[firsts[:-1]]) * down[firsts[:-1]] + n.astype(np.uint64))
    out[n == 0] = 0
    return out
