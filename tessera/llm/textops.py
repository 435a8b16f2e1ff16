"""Vectorised word tables and fingerprints over UTF-8 bytes.

A word is a maximal run of bytes other than space and \\t..\\r, which in UTF-8
is the same as `[^\\x20\\x09-\\x0D]+` on code points.  All hashes are fixed
functions of the bytes, so equal words have equal hashes in every process.
A hash only proposes that words are equal; `Words.codes` names them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

# Bytes of text worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 500_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SHIFTS = tuple(np.uint64(s) for s in (30, 27, 31))
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> _SHIFTS[0])
    x *= _M1
    x ^= x >> _SHIFTS[1]
    x *= _M2
    x ^= x >> _SHIFTS[2]
    return x


# Each place of a sequence has its own odd factor.
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * _BASE) | np.uint64(1)
# Words of more bytes than this are hashed one by one.
_LONG_WORD = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


@dataclass
class Words:
    """buf: bytes; start, end: each word's bytes; first: each text's first word, one more at the end; at: each text's first byte, one more."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    at: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts), self.counts())

    def codes(self) -> np.ndarray:
        """A number for each word; equal numbers mean equal words."""
        size = self.end - self.start
        at = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=at[1:])
        kept = np.ascontiguousarray(self.buf[~WHITE[self.buf]])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(kept)])
        return found.dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes: 8 bytes a step, each step mixed; of long words a cryptographic one."""
        size = self.end - self.start
        room = np.concatenate([self.buf, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray(len(self.buf), dtype="<u8", buffer=room, strides=(1,))
        out = mix((size + (seed << 40)).astype(np.uint64) * _GOLDEN)
        at = np.arange(len(size))
        for done in range(0, _LONG_WORD, 8):
            if done:
                at = at[size[at] > done]
            if not len(at):
                break
            step = eight[self.start[at] + done] & _MASKS[np.minimum(size[at] - done, 8)]
            out[at] = mix(out[at] ^ step)
        for w in np.flatnonzero(size > _LONG_WORD).tolist():
            out[w] = int.from_bytes(blake2b(self.buf[self.start[w] : self.end[w]].tobytes(), digest_size=8, salt=seed.to_bytes(16, "little")).digest(), "little")
        return out


def word_table(data: list[bytes], lower: bool = False) -> Words:
    joined = b"\n".join(data) + b"\n" if data else b""
    buf = np.frombuffer(joined, dtype=np.uint8)
    if lower:
        buf = LOWER[buf]
    at = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum([len(d) + 1 for d in data], out=at[1:])
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~WHITE[buf]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(buf, start, end, np.searchsorted(start, at), at)


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive entries: entry p covers p..p+n-1."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        out += hashes[j : j + size] * _FACTORS[j]
    return mix(out)


def chunks(data: list[bytes], limit: int = CHUNK_BYTES, most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most `most` texts and at most `limit` bytes in all, or of one text."""
    at, size = 0, 0
    for i, d in enumerate(data):
        if i > at and (size + len(d) + 1 > limit or i - at >= most):
            yield at, i
            at, size = i, 0
        size += len(d) + 1
    if at < len(data):
        yield at, len(data)


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    return [b"" if b is None else b for b in column.cast("binary").to_pylist()]


def planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, all first bytes first, so that equal bytes lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int, kind) -> np.ndarray:
    full = np.dtype(kind).itemsize
    out = np.zeros((len(data) // width, full), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(kind).ravel()


def steps(x: np.ndarray) -> bytes:
    """Small numbers in near-ascending order, as packed differences."""
    return planes(np.diff(x.astype(np.int32), prepend=np.int32(0)), 4)


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, 4, np.int32), dtype=np.int32)
