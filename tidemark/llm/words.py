"""Words of many texts at once as numpy arrays: where they are, and 64-bit hashes of them."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the memory of :func:`hash_words`, and keeps it in a core's cache.
BLOCK = 1 << 17
ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def byte_class(kind: str) -> np.ndarray:
    """Which bytes belong to a word: ``space`` all but ASCII white space, ``alnum`` letters and digits.

    Bytes from 0x80 belong to both, so cutting UTF-8 bytes equals cutting code points.
    """
    inside = np.ones(256, bool)
    if kind == "space":
        inside[[0x20, *range(0x09, 0x0E)]] = False
    else:
        inside[:128] = False
        inside[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
    return inside


@cache
def lower_table() -> np.ndarray:
    """Bytes with A-Z turned to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def spans(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, firsts)``: byte spans of all words; text ``i`` has words ``firsts[i]:firsts[i + 1]``."""
    inside = byte_class(kind)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (uint64)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values by sorting: ``np.unique`` hashes them where nothing else is asked for, which takes
    many times as long and a set of all values beside the array."""
    x = np.sort(x, axis=None)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique(x, return_inverse=True)`` for values that mostly repeat: only the distinct ones are sorted."""
    coded = pa.array(x).dictionary_encode()
    values = coded.dictionary.to_numpy()
    order = np.argsort(values)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return values[order], place[coded.indices.to_numpy()]


@cache
def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    rng = np.random.default_rng(seed)
    letters = rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
    base = int(rng.integers(1, 2**63, dtype=np.uint64)) * 2 + 1 & (2**64 - 1)
    inverse = pow(base, -1, 2**64)

    def powers(of: int) -> np.ndarray:
        factors = np.full(BLOCK, of, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    return letters, powers(base), powers(inverse), base, inverse


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial of random letter values, then mixed.

    Works in blocks of ``BLOCK`` bytes; a word may cross blocks.
    """
    letters, powers, inverses, base, inverse = _tables(seed)
    high = np.zeros(len(ends), np.uint64)
    low = np.zeros(len(starts), np.uint64)
    scale = np.ones(len(starts), np.uint64)
    carry = np.uint64(0)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            shift, back = np.uint64(pow(base, at, 2**64)), np.uint64(pow(inverse, at, 2**64))
            sums = np.empty(len(block) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(letters[block] * powers[: len(block)], out=sums[1:])
            sums = sums * shift + carry
            a, b = np.searchsorted(starts, (at, at + len(block)))
            low[a:b] = sums[starts[a:b] - at]
            scale[a:b] = inverses[starts[a:b] - at] * back
            a, b = np.searchsorted(ends, (at + 1, at + len(block) + 1))
            high[a:b] = sums[ends[a:b] - at]
            carry = sums[-1]
        return mixed((high - low) * scale + (ends - starts).astype(np.uint64) * ODD)


def hash_text_words(text: str | bytes | None, kind: str, lower: bool, seed: int = 1) -> np.ndarray:
    """Word hashes of one text."""
    raw = text.encode() if isinstance(text, str) else text or b""
    data = np.frombuffer(raw, np.uint8)
    data = lower_table()[data] if lower else data
    starts, ends, _ = spans(data, np.array([0, len(data)]), kind)
    return hash_words(data, starts, ends, seed)
