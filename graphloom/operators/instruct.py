"""Instruction-tuning data: chat format, exact split, fixed-length token rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import shuffle_order

SYSTEM_TEXT = "You answer questions about one codebase, briefly and only from what it contains."


def to_instruction(examples: DataFrame, system: str = SYSTEM_TEXT) -> DataFrame:
    """messages, metadata of each example; the example's own metadata keys come last and win."""
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    head = F.to_json(F.struct("id", "type", "refs"), {"ignoreNullFields": "false"})
    own = F.coalesce(F.nullif(F.col("metadata"), F.lit("{}")), F.lit(""))
    merged = F.when(own == "", head).otherwise(F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(","), F.substring(own, 2, 1 << 20)))
    return examples.withColumn("h", head).select(
        F.array(msg("system", F.lit(system)), msg("user", F.col("prompt")), msg("assistant", F.col("response"))).alias("messages"),
        merged.alias("metadata"),
    )


def chatml(messages: Column) -> Column:
    """Messages of system, user and assistant between the chat marks, one a line."""
    known = F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant"))
    return F.array_join(
        F.transform(known, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>"))), "\n"
    )


def exact_split(df: DataFrame, key: str, fraction: float, seed: str = "42") -> DataFrame:
    """Adds split: exactly ceil(n * fraction) rows are validation, the lowest seeded hashes. Keys may not repeat.

    A histogram of the first 16 bits of the hash finds the part in which the cut lies, and
    only that part, one of 65536, is ordered; its last row of validation is the threshold
    that all rows are compared with, so nothing is joined or numbered.
    """
    name = F.col(key).cast("string")
    order = shuffle_order(name, seed)[0]
    sizes = {r["part"]: r["count"] for r in df.groupBy(F.substring(order, 1, 4).alias("part")).count().collect()}
    left = min(math.ceil(sum(sizes.values()) * fraction), sum(sizes.values()))
    if left <= 0:
        return df.withColumn("split", F.lit("train"))
    for part in sorted(sizes):
        if left <= sizes[part]:
            break
        left -= sizes[part]
    pair = F.struct(order.alias("h"), F.col(key).alias("k"))
    at = df.filter(F.substring(order, 1, 4) == part).select(pair.alias("x")).orderBy("x").limit(left).agg(F.max("x").alias("x")).first()["x"]
    first = (order < at["h"]) | ((order == at["h"]) & (F.col(key) <= F.lit(at["k"])))
    return df.withColumn("split", F.when(first, "validation").otherwise("train"))


def tokenize(df: DataFrame, text: str, load: Callable[[], Callable[[str], list[int]]], max_length: int, pad_id: int = 0) -> DataFrame:
    """input_ids, attention_mask, labels of fixed length; labels are the ids, padding included."""

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            yield part.map(lambda t: model(t or "")[:max_length])

    fill = lambda ids, v: F.concat(ids, F.array_repeat(F.lit(v), F.lit(max_length) - F.size(ids)))
    ids = df.select(encode(text).alias("ids"))
    ones = F.transform("ids", lambda _: F.lit(1))
    full = ids.select(fill(F.col("ids"), pad_id).alias("input_ids"), fill(ones, 0).alias("attention_mask"))
    return full.withColumn("labels", F.col("input_ids"))


def batches(df: DataFrame, size: int, shuffle: bool = False, seed: str = "42") -> Iterator[list]:
    """Lists of rows, streamed to the driver partition by partition."""
    if shuffle:
        key = F.to_json(F.struct(*df.columns))
        df = df.orderBy(*shuffle_order(key, seed))
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
