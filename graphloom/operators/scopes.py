"""Innermost enclosing interval of each point, without comparing points with intervals.

A dyadic-style tree of blocks, FAN times as wide each level, lies over the positions. An
interval is cut into the fewest blocks that make it up, at most 2 * (FAN - 1) a level. All
intervals that a block is part of cover the whole block, so that of these only the innermost
matters: one row a block, found by a combining maximum. A point lies in one block of each level;
it meets that row by an equi-join, and the best of these few is its answer. Work is points and
intervals times the levels, however deep the nesting and however many points an
interval holds, and no key gathers rows: the points of one large file spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 16


def levels_for(widest: int, fan: int = FAN) -> int:
    """Levels whose largest block is at least so wide."""
    n, width = 1, 1
    while width < widest:
        n, width = n + 1, width * fan
    return n


def _at_level(blocks: Column, level: int) -> Column:
    return F.transform(blocks, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))


def blocks_of(first: Column, last: Column, levels: int, fan: int = FAN) -> Column:
    """Blocks (level, block) that make up first..last, as an array of structs.

    At a level, the blocks that lie wholly within are low..high; those of them that make up no
    whole block of the next level are taken here. What has no block at a level has none above.
    """
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    inside = [(F.ceil(first / F.lit(fan**lv)).cast("bigint"), F.floor((last + 1) / F.lit(fan**lv)).cast("bigint") - 1) for lv in range(levels)]
    parts = []
    for level, (low, high) in enumerate(inside):
        here = run(low, high)
        if level + 1 < levels:
            up, down = inside[level + 1]
            here = F.when(up > down, here).otherwise(F.concat(run(low, up * fan - 1), run((down + 1) * fan, high)))
        parts.append(_at_level(here, level))
    return F.concat(*parts)


def enclosing(points: DataFrame, spans: DataFrame, key: list[str], fan: int = FAN) -> DataFrame:
    """points with scope: the id of the innermost span of its key that holds its place, or null.

    points: key, place and other columns; spans: key, first, last (inclusive), id. Innermost is the span
    that begins last; of these the one that ends first, then the smallest id. Spans that end
    before they begin, and null places, hold nothing. Keys are compared null-safely.
    """
    spans = spans.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col("first").cast("bigint").alias("_first"), F.col("last").cast("bigint").alias("_last"), F.col("id").alias("_id")).filter("_first <= _last")
    spans = spans.filter("_id IS NOT NULL")
    bounds = spans.agg(F.min("_first").alias("low"), F.max("_last").alias("high")).first()
    if bounds["low"] is None:
        return points.withColumn("scope", F.lit(None).cast(spans.schema["_id"].dataType))
    low, levels = bounds["low"], levels_for(bounds["high"] - bounds["low"] + 1, fan)
    # places count from the lowest
    cut = spans.withColumn("_b", F.explode(blocks_of(F.col("_first") - low, F.col("_last") - low, levels, fan)))
    rank = F.struct(F.col("_first").alias("a"), (-F.col("_last")).alias("b"))
    keys = [f"_k{i}" for i in range(len(key))]
    best = cut.groupBy(*keys, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).agg(F.max(rank).alias("_rank"), F.min_by("_id", F.struct(-F.col("_first"), F.col("_last"), F.col("_id"))).alias("_id"))

    # the answer depends on key and place alone, so that each place is asked for once
    asked = points.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(key)], F.col("place").cast("bigint").alias("_place")).distinct()
    at = F.array(*[F.struct(F.lit(lv).alias("level"), F.floor((F.col("_place") - low) / F.lit(fan**lv)).cast("bigint").alias("block")) for lv in range(levels)])
    probe = asked.filter(F.col("_place").between(low, bounds["high"])).withColumn("_q", F.explode(at))
    same = (F.col("_q.level") == F.col("_level")) & (F.col("_q.block") == F.col("_block"))
    for i in range(len(key)):
        same &= F.col(f"_p{i}").eqNullSafe(F.col(f"_k{i}"))
    mine = [f"_p{i}" for i in range(len(key))]
    met = probe.join(best, same).groupBy(*mine, "_place").agg(F.min_by("_id", F.struct(-F.col("_rank.a"), -F.col("_rank.b"), F.col("_id"))).alias("scope"))
    back = F.col("place").cast("bigint") == F.col("_place")
    for c, m in zip(key, mine, strict=True):
        back &= F.col(c).eqNullSafe(F.col(m))
    return points.join(met, back, "left").drop(*mine, "_place")
