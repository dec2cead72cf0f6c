"""Words and their 64-bit hashes for a whole Arrow batch of texts at once.

A text is cut at white space (space and bytes 9 to 13).  Word hashes come from one running polynomial over the bytes of a
chunk, so there is no Python loop over words.  Texts are worked on in chunks of about ``CHUNK`` bytes; a longer text is a
chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(*parts: int) -> np.uint64:
    """One 64-bit number for a few small integers."""
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = mix(x * _ODD + np.uint64(p & 0xFFFFFFFFFFFFFFFF) + np.uint64(1))
    return x[0]


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)
        inverse = int(base)
        for _ in range(6):
            inverse = inverse * (2 - int(base) * inverse) % (1 << 64)
        self.inverse = np.uint64(inverse)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))
        return self.up, self.down


_BYTES, _WORDS = Powers(_STEP), Powers(_ODD)
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def text_bytes(column: pa.Array, kind: pa.DataType = pa.large_string()) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and where each text begins (one more entry at the end)."""
    column = column.cast(kind).fill_null(pa.scalar("", kind))
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def spans(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have about ``limit`` bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of the texts of one chunk, in order."""

    first: int  # row of the first text in the batch
    at: np.ndarray  # per text, and at the end: index of its first word
    start: np.ndarray  # byte where a word starts, in data
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    byte_at: np.ndarray  # per text, and at the end: where its bytes begin

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all k-word windows inside one text, and the windows' hashes."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _WORDS.of(n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=c[1:])
        last = np.repeat(self.at[1:], np.diff(self.at)) - k
        pos = np.flatnonzero(np.arange(n) <= last)
        return pos, mix((c[pos + k] - c[pos]) * down[pos])

    def whole(self) -> np.ndarray:
        """Per text two hashes (n, 2) of its whole word sequence."""
        n = len(self.hash)
        up, down = _WORDS.of(n + 1)
        out = []
        for salt in (1, 2):
            c = np.zeros(n + 1, np.uint64)
            np.cumsum((self.hash if salt == 1 else mix(self.hash + _STEP)) * up[:n], out=c[1:])
            out.append(mix((c[self.at[1:]] - c[self.at[:-1]]) * down[self.at[:-1]] + np.diff(self.at).astype(np.uint64)))
        return np.stack(out, axis=1)


def words(column: pa.Array, fold: bool = False) -> Iterator[Words]:
    """``fold`` lower-cases A-Z, no other letter."""
    data, at = text_bytes(column)
    for i, j in spans(at):
        own = data[at[i] : at[j]]
        if fold:
            own = _FOLD[own]
        yield _split(i, own, at[i : j + 1] - at[i])


def _split(first: int, data: np.ndarray, at: np.ndarray) -> Words:
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(first, np.zeros(len(at), np.int64), none, none, np.zeros(0, np.uint64), data, at)
    inside = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < n]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _BYTES.of(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:n], out=c[1:])
    hashes = mix((c[end] - c[start]) * down[start])
    return Words(first, np.searchsorted(start, at).astype(np.int64), start, end, hashes, data, at)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
