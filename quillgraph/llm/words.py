"""Words of many texts at once: hashing with array operations instead of loops over words.

Word: an unbroken stretch of letters and digits, lower-cased. A batch of texts becomes one
array of code points; words are found and hashed by a handful of passes over it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MUL
        return (x ^ (x >> np.uint64(27))) * _MIX ^ (x >> np.uint64(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a line end after each, and where each text begins."""
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    joined = "\n".join(texts) + "\n" if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(lens)])[:-1] if len(texts) else np.zeros(0, np.int64)


#: Texts are worked on in lots of about so many characters, which stay in the cache.
LOT = 1 << 20


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0x100000001B3
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hashes, text_of_word, first_char``: words of all texts in order.

    A null text has no words. ``first_char`` counts within the lot of texts hashed together.
    """
    low = [(t or "").lower() for t in texts]
    parts, begin, chars = [], 0, 0
    for k, t in enumerate(low):
        chars += len(t) + 1
        if chars >= LOT or k == len(low) - 1:
            h, o, s = hash_runs(*code_points(low[begin : k + 1]))
            parts.append((h, o + begin, s))
            begin, chars = k + 1, 0
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def hash_runs(codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from code points and text starts."""
    inside = letter_table()[codes]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), start
    kept = codes[inside].astype(np.uint64)
    at = np.flatnonzero(first[inside])
    up, down = _powers(max(2 * LOT, 1 << int(len(kept)).bit_length()))
    with np.errstate(over="ignore"):
        value = np.add.reduceat((kept + np.uint64(0x9E37)) * (kept * _MIX | np.uint64(1)) * up[: len(kept)], at) * down[at]
        hashes = mix64(value + np.diff(np.append(at, len(kept))).astype(np.uint64) * _MUL)
    return hashes, np.searchsorted(begins, start, "right") - 1, start


def ordered(owner: np.ndarray, high: np.ndarray, high_bits: int, low: np.ndarray) -> np.ndarray:
    """The order of rows by owner, then ``high``, then ``low`` (64-bit unsigned)."""
    bits = max(1, int(owner.max(initial=0)).bit_length())
    rest = 64 - bits - high_bits
    key = owner.astype(np.uint64) << np.uint64(64 - bits) | low >> np.uint64(64 - rest)
    if high_bits:
        key |= high.astype(np.uint64) << np.uint64(rest)
    order = np.argsort(key)
    sorted_key = key[order]
    if (sorted_key[1:] == sorted_key[:-1]).any():  # equal up to the bits that fit: settle it in full
        return np.lexsort((low, high, owner))
    return order


def shingles(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within one text, and the text of each."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        run = np.zeros(n, np.uint64)
        for k in range(size):
            run = mix64(run * _MUL + hashes[k : k + n] + np.uint64(k))
    whole = owner[:n] == owner[size - 1 :]
    return run[whole], owner[:n][whole]
