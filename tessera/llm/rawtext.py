"""Numpy views of Arrow text columns: bytes, word spans and word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Random but fixed: a 64-bit value per byte, and the odd base of the positions.
_rng = np.random.default_rng(7)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64)
BASE = U64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space, and of words of letters and digits.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more at the end). Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string() if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else pa.large_binary())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and how many words precede each text's first (one more at the end)."""
    inside = is_word[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    edges = off[:-1][off[:-1] < len(buf)]
    before[edges] = False
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: A random value for each byte at each of so many places of a span; stretches of so many bytes are then weighed.
PLACES = 64
PLACE_VALUES = _rng.integers(0, 2**64, (PLACES, 256), dtype=np.uint64)


def weights(n: int) -> np.ndarray:
    """Odd numbers without a pattern, one per stretch of ``PLACES`` bytes; the first is 1."""
    out = mix64(np.arange(n, dtype=U64) * BASE) | U64(1)
    out[:1] = 1
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and don't overlap. ``fold`` maps bytes first.

    Each byte adds a random value of its own for its place, so unlike a polynomial
    modulo 2**64 the hash has no texts that collide by their structure.
    """
    if not len(starts):
        return np.zeros(0, U64)
    n = ends - starts
    first = np.cumsum(n) - n
    whole = int(n.sum()) == len(buf)
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    text = buf if whole else buf[np.repeat(starts, n) + place]
    if fold is not None:
        text = fold[text]
    value = PLACE_VALUES.ravel()[((place & (PLACES - 1)) << 8) | text]
    longest = int(n.max())
    if longest > PLACES:
        value *= weights(-(-longest // PLACES))[place >> 6]
    sums = np.add.reduceat(value, first)
    return mix64(sums + n.astype(U64))
