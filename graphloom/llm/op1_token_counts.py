"""Token counts by a separator scan of flat, unindexed token files.

Texts are encoded and laid end to end in flat streams of 16-bit ids, each document
closed by the end-of-document id, and the streams are cut into blocks of fixed size
wherever the cut falls. Nothing in a block says where documents lie. Counting finds all
separators of a block in one vectorised comparison; a block yields the tokens before its
first separator, the gaps between, and the tokens after its last. A prefix scan over the
block summaries of a stream carries the open length and the document ordinal across
blocks. The order of documents is kept beside each stream and joined by ordinal.

A stream is what one input task wrote, so it has a bounded number of blocks.

Results for edge cases: a null or empty text has 0 tokens; a very long text is encoded whole and
lies across as many blocks as it needs; a text that spells the
end-of-document mark is ordinary text; a null doc_id stays null; repeated rows are each
counted; a stream's end without a separator closes its last document if it has tokens;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.staging import prepare, scratch, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The id that is free in the vocabulary, and its published split pattern.
END = 50256
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1 << 19  # tokens of a block
_encoders: dict[int, object] = {}


def encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary file, made once a worker."""
    key = hash(vocabulary)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


FLAT = "kind int, stream int, place long, tokens binary, ids array<long>"


def flatten(vocabulary, end: int, block: int):
    """Blocks (kind 0) of the partition's stream and the order of its documents (kind 1)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary.value).encode_ordinary
        stream, held, size, place, ordinal = TaskContext.get().partitionId(), [], 0, 0, 0
        for part in parts:
            rows = []
            for text in part["text"]:
                ids = np.array([*encode(text or ""), end], "<u2")
                held.append(ids)
                size += len(ids)
                if size >= block:
                    flat = np.concatenate(held)
                    for at in range(0, size - block + 1, block):
                        rows.append((0, stream, place, flat[at : at + block].tobytes(), None))
                        place += 1
                    held = [flat[size - size % block :]]
                    size %= block
            docs = [None if pd.isna(d) else int(d) for d in part["doc_id"]]
            rows.append((1, stream, ordinal, None, docs))
            ordinal += len(docs)
            yield pd.DataFrame(rows, columns=["kind", "stream", "place", "tokens", "ids"])
        if size:
            yield pd.DataFrame([(0, stream, place, np.concatenate(held).tobytes(), None)], columns=["kind", "stream", "place", "tokens", "ids"])

    return run


def write_flat(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """blocks (stream, place, tokens) and order (stream, place, ids) of docs (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())  # the file, about 1 MB
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    flat = stage(given.mapInPandas(flatten(shared, end, block), FLAT), "tokens", "kind")
    return flat.filter("kind = 0").select("stream", "place", "tokens"), flat.filter("kind = 1").select("stream", "place", "ids")


SCANNED = "stream int, place long, n long, seps long, head long, last long, gaps binary"


def scan(end: int):
    """Summary of each block: its length, separators, and the gaps between them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for stream, place, data in zip(part["stream"], part["place"], part["tokens"], strict=True):
                ids = np.frombuffer(data, "<u2")
                at = np.flatnonzero(ids == end)
                gaps = (np.diff(at) - 1).astype("<i8").tobytes()
                rows.append((stream, place, len(ids), len(at), int(at[0]) if len(at) else len(ids), int(at[-1]) if len(at) else -1, gaps))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCANNED.split(", ")])

    return run


COUNTED = "stream int, ordinal long, start long, n_tokens long"


def close(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents that end in each block: the first takes what earlier blocks left open."""
    for part in parts:
        out = []
        for r in part.itertuples(index=False):
            if r.seps:
                n = np.concatenate(([r.carry + r.head], np.frombuffer(r.gaps, "<i8")))
                stops = r.begin + r.head + np.concatenate(([0], np.cumsum(n[1:] + 1)))
                out.append(pd.DataFrame({"stream": r.stream, "ordinal": r.ordinal + np.arange(len(n)), "start": stops - n, "n_tokens": n}))
            if r.final and (left := r.n - r.last - 1 + (0 if r.seps else r.carry)):
                out.append(pd.DataFrame({"stream": r.stream, "ordinal": [r.ordinal + r.seps], "start": [r.begin + r.n - left], "n_tokens": [left]}))
        if out:
            yield pd.concat(out)


def count_tokens(blocks: DataFrame, end: int = END) -> DataFrame:
    """stream, ordinal, start, n_tokens of each document of the blocks (stream, place, tokens)."""
    summary = stage(blocks.mapInPandas(scan(end), SCANNED), "summaries")
    w = Window.partitionBy("stream").orderBy("place")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = summary.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("ordinal", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    stop = F.when(F.col("seps") > 0, F.col("begin") + F.col("last"))
    placed = placed.withColumn("carry", F.col("begin") - 1 - F.coalesce(F.max(stop).over(before), F.lit(-1))).withColumn("final", F.lead("place").over(w).isNull())
    return placed.mapInPandas(close, COUNTED)


def document_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, stream, start of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        blocks, order = write_flat(docs, vocabulary)
        named = order.select("stream", "place", F.posexplode("ids").alias("i", "doc_id")).select("stream", (F.col("place") + F.col("i")).alias("ordinal"), "doc_id", F.lit(True).alias("named"))
        both = named.join(count_tokens(blocks), ["stream", "ordinal"], "full")
        whole = F.col("named") & F.col("n_tokens").isNotNull()
        n = F.when(whole, F.col("n_tokens")).otherwise(F.raise_error(F.lit("documents and separators of a stream do not match")).cast("bigint"))
        return keep(both.select("doc_id", n.alias("n_tokens"), "stream", "start"), "counted")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
