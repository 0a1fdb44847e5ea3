"""Text vectors from hashed words, weighted by how rare they are; column expressions throughout.

A word's number, a hash, modulo the size names its dimension. The weight of a dimension in a
text is its count there times ln((n + 1) / (texts that have it + 1)) + 1, and vectors have
length one. The table of rarities has at most as many rows as dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import hash_number

WORDS = "[0-9a-z]+"
SIZE = 256


def term_counts(texts: DataFrame, size: int = SIZE, key: str = "id", text: str = "summary") -> DataFrame:
    """key, dim, n: how often words of each dimension occur in a text; a text without words has no row."""
    word = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({WORDS})"), 1))
    return texts.select(key, word.alias("word")).select(key, (hash_number("word", "dim") % size).cast("int").alias("dim")).groupBy(key, "dim").agg(F.count("*").alias("n"))


def fit(texts: DataFrame, size: int = SIZE, key: str = "id", text: str = "summary") -> DataFrame:
    """dim, idf of every dimension, from all texts; dimensions that no text has are the rarest."""
    held = term_counts(texts, size, key, text).groupBy("dim").agg(F.count("*").alias("df"))
    total = texts.agg(F.count("*").alias("total"))
    every = texts.sparkSession.range(size).select(F.col("id").cast("int").alias("dim"))
    idf = F.log((F.col("total") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    return every.join(F.broadcast(held), "dim", "left").join(F.broadcast(total)).select("dim", idf.alias("idf"))  # size rows, one row


def weights(texts: DataFrame, idf: DataFrame, size: int = SIZE, key: str = "id", text: str = "summary") -> DataFrame:
    """key, entries: the dimensions of each text that has words, and their weights."""
    each = term_counts(texts, size, key, text).join(F.broadcast(idf), "dim").withColumn("w", F.col("n") * F.col("idf"))
    per = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "w"))).alias("entries"))  # at most size
    norm = F.sqrt(F.aggregate("entries", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return per.withColumn("norm", norm).select(key, F.transform("entries", lambda x: F.struct(x["dim"].alias("dim"), (x["w"] / F.col("norm")).alias("w"))).alias("entries"))


def embed(texts: DataFrame, idf: DataFrame, size: int = SIZE, key: str = "id", text: str = "summary") -> DataFrame:
    """texts with embedding, of the size given; zeros for a text without words."""
    vectors = weights(texts, idf, size, key, text).select(F.col(key).alias("_key"), F.map_from_entries("entries").alias("_at"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("_at")[i], F.lit(0.0)).cast("float"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    kept = [c for c in texts.columns if c != "embedding"]
    out = texts.select(*kept).join(vectors, F.col(key) == F.col("_key"), "left")
    return out.select(*kept, F.when(F.col("_at").isNull(), zeros).otherwise(dense).alias("embedding"))


def encode_query(spark, text: str, idf: DataFrame, size: int = SIZE) -> list[float]:
    """The vector of one text."""
    return embed(spark.createDataFrame([("q", text)], "id string, summary string"), idf, size).first()["embedding"]
