"""Words of whole Arrow text columns as 64-bit hashes, by numpy over all bytes of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)

#: Bytes of a token: all but blank, tab, line feed, carriage return.
TOKEN_BYTES = np.ones(256, bool)
TOKEN_BYTES[[9, 10, 13, 32]] = False
#: Bytes of a word: ASCII letters and digits, and every byte of other characters.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        p = np.full(max(n, 256), _BASE, np.uint64)
        p[0] = 1
        _POW = np.cumprod(p, dtype=np.uint64)
    return _POW


def _large(texts: pa.Array) -> pa.Array:
    """``texts`` with 64-bit offsets; binary columns stay binary, as they needn't be UTF-8."""
    return texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) with some ``limit`` bytes of text each, or one longer text."""
    texts = _large(texts)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, with the end; null is as empty."""
    texts = _large(texts)
    texts = pc.fill_null(texts, pa.scalar("" if pa.types.is_large_string(texts.type) else b"", texts.type))
    _, off, data = texts.buffers()
    at = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def spans(data: np.ndarray, at: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of ``kept`` bytes, none across texts, and each text's first run, with the end."""
    inside = kept[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    begin = np.zeros(len(n), np.int64)
    np.cumsum(n[:-1], out=begin[1:])
    place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(begin, n)
    byte = data[place + np.repeat(starts, n)]
    sums = np.add.reduceat(_BYTE[byte] * _powers(int(n.max()))[place], begin)
    return mix(sums + n.astype(np.uint64) * _BASE)


def words(texts: pa.Array, kept: np.ndarray = WORD_BYTES, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin, with the end."""
    data, at = raw(pc.utf8_lower(texts) if lower else texts)
    starts, ends, offsets = spans(data, at, kept)
    return hashes(data, starts, ends), offsets
