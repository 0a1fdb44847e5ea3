"""Word shingles of whole texts as 64-bit hashes, many texts at once.

Words are the runs of bytes outside space and \\x09-\\x0D, A-Z lowered. A word's hash is a
polynomial in its bytes, drawn from a random table, with an odd base modulo 2**64; it
comes from prefix sums, so the work is a few vector passes over the bytes. Hashes are
finished with a bijective mixer. Two different shingles of one comparison collide with a
probability near 2**-64.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
MOST_WORDS = 16
_SEEDS = _rng.integers(1, 2**63, MOST_WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits (the finisher of a public-domain generator)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _powers[kind] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of each word of the bytes."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    terms = _TABLE[data]
    terms *= _power("up", _BASE, len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    h = (sums[end] - sums[start]) * _power("down", _INVERSE, len(data) + 1)[start]
    return start, mix(h + (end - start).astype(np.uint64) * _SEEDS[MOST_WORDS])


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the index of their text, sorted by both and without repeats.

    A text with fewer words than a shingle has its word sequence as one; without words, none.
    Texts may be empty, repeat, or be very long; without texts both arrays are empty.
    A shingle may have at most MOST_WORDS words.
    """
    if not 1 <= words <= MOST_WORDS:
        raise ValueError(f"words must lie in [1, {MOST_WORDS}]: {words}")
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(length)
    start, h = word_hashes(data)
    doc = np.searchsorted(ends, start, "right")
    count = np.bincount(doc, minlength=len(texts))
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    made = np.zeros(n, np.uint64)
    pad = np.concatenate((h, np.zeros(words - 1, np.uint64)))
    for i in range(words):
        made += pad[i : i + n] * _SEEDS[i]
    first = np.cumsum(count) - count
    place = np.arange(n) - first[doc]
    whole = place + words <= count[doc]
    short = (place == 0) & (count[doc] < words)
    for at in np.flatnonzero(short):  # the words beyond the text's own may not count
        k = int(count[doc[at]])
        made[at] = (h[at : at + k] * _SEEDS[:k]).sum(dtype=np.uint64) + np.uint64(k)
    keep = whole | short
    out, who = mix(made[keep]), doc[keep]
    bounds = np.searchsorted(who, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (who[1:] != who[:-1])
    return out[new], who[new]
