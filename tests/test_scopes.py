"""The interval join against a search of all intervals."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators.scopes import blocks_of, enclosing, levels_for

SPANS, POINTS = "file string, first long, last long, id string, place string", "file string, place long, name string, first string"


def brute(points, spans):
    out = []
    for f, at, name, x in points:
        held = [(-a, b, i) for g, a, b, i, _ in spans if g == f and i is not None and None not in (a, b, at) and a <= at <= b]
        out.append((f, at, name, x, min(held)[2] if held else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_innermost_of_nested_and_crossing_spans(spark, fan):
    rng = random.Random(fan)
    spans = []
    for i in range(300):
        a = rng.randrange(-50, 4000)
        spans.append((rng.choice(["a", "a", "b", None]), a, a + rng.choice([-1, 0, 1, 15, 16, 17, 900, 5000]), rng.choice([f"s{i}", f"s{i}", None]), "clash"))
    spans += [(f, a, b, f"{i}again", c) for f, a, b, i, c in spans[:40]] + [("a", None, 9, "n", ""), ("a", 0, None, "n", "")]
    points = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *[rng.randrange(-100, 9500)] * 30]), str(i), "x") for i in range(500)]
    points += points[:20]
    got = enclosing(spark.createDataFrame(points, POINTS).repartition(5), spark.createDataFrame(spans, SPANS).repartition(3), ["file"], fan)
    assert got.columns == ["file", "place", "name", "first", "scope"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(points, spans)


def test_empty_tables(spark):
    points, spans = spark.createDataFrame([("a", 1, "n", "x")], POINTS), spark.createDataFrame([("a", 0, 5, "s", "")], SPANS)
    assert enclosing(points, spans.limit(0), ["file"]).collect()[0]["scope"] is None
    assert enclosing(points.limit(0), spans, ["file"]).count() == 0


def test_blocks_make_up_the_span(spark):
    pairs = [(a, b) for a in range(0, 70, 7) for b in range(a, 80, 3)]
    df = spark.createDataFrame(pairs, "a long, b long")
    levels = levels_for(80, 4)
    for r in df.select("a", "b", blocks_of(F.col("a"), F.col("b"), levels, 4).alias("x")).collect():
        held = sorted(p for x in r["x"] for p in range(x["block"] * 4 ** x["level"], (x["block"] + 1) * 4 ** x["level"]))
        assert held == list(range(r["a"], r["b"] + 1))
        assert len(r["x"]) <= 2 * 3 * levels


def test_one_file_with_very_many_calls(spark):
    """200,000 calls in one file of 100,000 spans, nested a thousand deep: all pairs would be 10^8."""
    n = 100_000
    i = F.col("id")
    spans = spark.range(n).select(F.lit("f").alias("file"), F.when(i < 1000, i).otherwise(1000 + i * 10).alias("first"), F.when(i < 1000, 10**7 - i).otherwise(1005 + i * 10).alias("last"), i.cast("string").alias("id"))
    points = spark.range(2 * n).select(F.lit("f").alias("file"), (F.col("id") * 5 + 11_000).alias("place"))
    began = time.time()
    got = enclosing(points, spans, ["file"]).withColumn("want", F.when(F.col("place") - (F.floor(F.col("place") / 10) * 10) <= 5, F.floor(F.col("place") / 10) - 100).cast("bigint"))
    wrong = got.filter(F.when((F.col("want") >= 1000) & (F.col("want") < n), F.col("scope") != F.col("want").cast("string")).otherwise(F.col("scope") != "999")).count()
    assert wrong == 0 and time.time() - began < 120
