"""Byte-pair encoding against a plain search, and against the published library."""

from __future__ import annotations

import random
import time

import pytest

from graphloom.operators import bpe, instruct

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def plain(piece: bytes, ranks) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def random_ranks(rng, letters=b"abc", merges=60):
    names = [bytes([i]) for i in range(256)]
    while len(names) < 256 + merges:
        new = rng.choice(names[97:100] + names[256:]) + rng.choice(names[97:100] + names[256:])
        if new not in names and len(new) < 9:
            names.append(new)
    return {b: i for i, b in enumerate(names)}


@pytest.mark.parametrize("seed", range(6))
def test_merges_equal_a_search_of_all_pairs(seed):
    rng = random.Random(seed)
    ranks = random_ranks(rng)
    for _ in range(400):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 40)))
        assert bpe.merge(piece, ranks) == plain(piece, ranks)
    assert bpe.merge(b"aaaaaaa" * 3, ranks) == plain(b"aaaaaaa" * 3, ranks)


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.read_ranks(spark, VOCABULARY)


def test_parity_with_the_library(spark, ranks, sf_dir):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("x", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})
    encode = bpe.encoder(ranks)
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r[0]]
    texts += ["", " ", "it's  a\n\n test's", "x" * 5000, "é日本語🎉 123 4567", "don't!!!  \t\t end ", " a b"]
    for text in texts:
        got = encode(text)
        assert got == other.encode_ordinary(text) and bpe.decode(got, ranks) == text


def test_long_pieces_take_little_more_than_linear_time(ranks):
    rng, took, names = random.Random(1), [], {i: b for b, i in ranks.items()}
    for n in (20_000, 200_000):
        piece = "".join(rng.choice("abcdefgh") for _ in range(n)).encode()
        began = time.perf_counter()
        ids = bpe.merge(piece, ranks)
        took.append(time.perf_counter() - began)
        assert b"".join(names[i] for i in ids) == piece
    assert took[1] < 40 * took[0] + 1


def test_rows_are_cut_and_filled(spark, ranks):
    df = spark.createDataFrame([("one two three four",), ("one",), ("",), (None,)], "t string")
    rows = instruct.tokenize(df, "t", bpe.loader(spark, ranks), 3, 9).collect()
    ids = bpe.encoder(ranks)("one two three four")
    assert [list(r["input_ids"]) for r in rows] == [ids[:3], [ids[0], 9, 9], [9, 9, 9], [9, 9, 9]]
    assert [list(r["attention_mask"]) for r in rows] == [[1, 1, 1], [1, 0, 0], [0, 0, 0], [0, 0, 0]] and all(r["labels"] == r["input_ids"] for r in rows)
