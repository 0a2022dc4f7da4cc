"""Words, word hashes and shingles of whole Arrow batches of text, as numpy arrays.

Every function works on the UTF-8 bytes of many texts at once, so a task holds one
bounded slice of its rows and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows are worked on in slices of at most so many bytes of text (or one row).
SLICE_BYTES = 1_000_000


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


LOWER = _lower_table()
#: bytes of `[^\x20\x09-\x0D]+`
NOT_SPACE = ~_class((0x20, 0x20), (0x09, 0x0D))
#: bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, and of A-Z, which are lower-cased first
ALNUM = _class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _spread(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * _ODD)


_CHAR = _spread(256, 17)[LOWER]
_PLACE = _spread(8, 1009) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93


class _Powers(dict):
    """Powers worked out in this process; functions that are sent to workers leave them behind."""

    def __reduce__(self):
        return _Powers, ()


_POWERS = _Powers()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Texts:
    """The bytes of some texts, each followed by one space; nulls count as empty."""

    def __init__(self, strings: pa.Array):
        strings = pc.fill_null(strings.cast(pa.large_string()), "")
        ended = pc.binary_join_element_wise(strings, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        self.n = len(ended)
        _, offsets, data = ended.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[ended.offset : ended.offset + self.n + 1]
        self.data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
        self.offsets = at - at[0]

    def words(self, kind: np.ndarray) -> Words:
        edges = np.diff(kind[self.data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        return Words(self, starts, ends, np.searchsorted(starts, self.offsets))


class Words:
    """Byte spans of words; those of text ``i`` are ``offsets[i]:offsets[i + 1]``."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray):
        self.texts, self.starts, self.ends, self.offsets = texts, starts, ends, offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word with A-Z lower-cased; equal words, equal hashes."""
        up, down = _powers(len(self.texts.data) + 1)
        sums = np.empty(len(self.texts.data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_CHAR[self.texts.data] * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles.

    A text with fewer than ``width`` words has its whole sequence as the only one, a
    text without words has none.
    """
    n = len(hashes)
    joined = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        joined += hashes[k : n - width + 1 + k] * _PLACE[k] if len(joined) else 0
    joined = mix(joined)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        m = end - start
        if m >= width:
            found = np.sort(joined[start : end - width + 1])
            keep = np.empty(len(found), dtype=bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif m:
            whole = (hashes[start:end] * _PLACE[:m]).sum(dtype=np.uint64) + np.uint64(m)
            yield mix(np.array([whole], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def runs(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes (a row) of each run ``starts:ends`` of word hashes, however far runs overlap."""
    up, down = _powers(len(hashes) + 1)
    out = np.empty((len(starts), 2), dtype=np.uint64)
    for column, values in enumerate((hashes, mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)))):
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:-1], out=sums[1:])
        out[:, column] = mix((sums[ends] - sums[starts]) * down[starts])
    return out


class Condensed:
    """Texts as the lower-cased runs of a byte class, each followed by one space, in one buffer."""

    def __init__(self, texts: Texts, kind: np.ndarray):
        inside = kind[texts.data]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        self.source = np.flatnonzero(keep)
        self.data = np.where(inside, LOWER[texts.data], np.uint8(32))[self.source]
        self.offsets = np.searchsorted(self.source, texts.offsets)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``size`` bytes in ``column``; a longer row comes alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, end - start)
        start = end
