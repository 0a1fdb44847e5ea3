"""Byte-pair encoding by merge ranks, for training rows.

A vocabulary gives byte strings their ranks, which are their ids; a lower rank merges
first. Text is cut into pieces by a pattern, and a piece into bytes; the adjacent pair whose
joined bytes have the lowest rank is merged, the leftmost first, until no pair has one. Pairs
wait in a heap, and a merge looks at its two neighbours only, so a piece of n bytes takes
n log n steps. Pieces that were seen are remembered, up to a bound.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import SparkSession

# Fixed value: the published pattern that parts text into pieces for byte-level vocabularies.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 1 << 16

Ranks = dict[bytes, int]


def read_ranks(spark: SparkSession, path: str) -> Ranks:
    """Ranks of a vocabulary file: a line for each, its bytes in base 64 and its rank. Any path that the engine reads."""
    return {base64.b64decode(a): int(b) for a, b in (r[0].split() for r in spark.read.text(path).filter("value <> ''").collect())}


def merge(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of a piece; every single byte must have a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins at a place
    before = list(range(-1, n - 1))  # the part before it
    alive = [True] * n

    def rank_at(i: int) -> int | None:
        j = end[i]
        return ranks.get(piece[i : end[j]]) if j < n else None

    heap = [(r, i, end[end[i]]) for i in range(n - 1) if (r := rank_at(i)) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of the two has been merged since
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        for k in (i, before[i]):
            if k >= 0 and (r := rank_at(k)) is not None:
                heappush(heap, (r, k, end[end[k]]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def encoder(ranks: Ranks, pattern: str = PIECES) -> Callable[[str], list[int]]:
    """A function from text to ids."""
    pieces = regex.compile(pattern)
    one = lru_cache(REMEMBERED)(lambda piece: tuple(merge(piece, ranks)))

    def encode(text: str) -> list[int]:
        return [i for m in pieces.finditer(text) for i in one(m[0].encode("utf-8", "surrogatepass"))]

    return encode


def decode(ids: list[int], ranks: Ranks) -> str:
    names = {i: b for b, i in ranks.items()}
    return b"".join(names[i] for i in ids).decode("utf-8", "replace")


def loader(spark: SparkSession, ranks: Ranks, pattern: str = PIECES) -> Callable[[], Callable[[str], list[int]]]:
    """What tokenize() takes: the encoder, made once a task from a broadcast vocabulary (a megabyte or so)."""
    shared = spark.sparkContext.broadcast(ranks)
    return lambda: encoder(shared.value, pattern)
