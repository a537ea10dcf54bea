"""Word shingles of whole texts as 64-bit hashes, by numpy over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer text is a group of its own. Hashing takes some 40 bytes for each of them.
GROUP, HASHED = 1 << 20, 1 << 18

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_STEP = _U(0x9E3779B97F4A7C15)


def tidy() -> None:
    """Gives back the memory that a task has freed: Python workers live on, beside the next tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, how many words each text has)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    solid = ~_BLANK[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    at = np.flatnonzero(begins)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(at, ends, "left"), prepend=0)
    if not len(at):
        return np.zeros(0, np.uint64), counts
    chars = raw[solid]
    first = np.flatnonzero(begins[solid])
    lengths = np.diff(first, append=len(chars))
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    powers = _powers(int(lengths.max()) + 1, _STEP)
    return mix(np.add.reduceat(_BYTE[chars] * powers[place], first) + lengths.astype(np.uint64)), counts


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For every text the sorted distinct hashes of its shingles; of all its words as one where they are fewer; none without words."""
    hashes, counts = word_hashes(texts)
    powers = _powers(width, _U(0xD6E8FEB86659FD93))
    n = len(hashes) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        rolled += hashes[j : j + n] * powers[j]
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            few = (hashes[at : at + c] * powers[:c]).sum(dtype=np.uint64) + _U(c)
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def grouped(texts: Iterable[bytes | None], most: int = GROUP) -> Iterator[list[bytes]]:
    """Texts in groups of about ``most`` bytes; null counts as empty."""
    group, size = [], 0
    for t in texts:
        t = t or b""
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    if group:
        yield group
