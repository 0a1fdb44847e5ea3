"""Semantic classification of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.rules import semantic_type
from graphloom.schema import SEMANTIC_TYPES


def classify(nodes: DataFrame) -> DataFrame:
    """Nodes with their semantic type; running it twice changes nothing."""
    return nodes.withColumn("type", semantic_type(F.col("type"), F.col("name")))


def classification_counts(classified: DataFrame) -> DataFrame:
    """type, count of every type met and, with 0, of every semantic type not met."""
    zero = classified.sparkSession.createDataFrame([(t,) for t in SEMANTIC_TYPES], "type string")
    counts = classified.groupBy("type").agg(F.count("*").alias("count"))
    return zero.join(counts, "type", "full").select("type", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def classification_stats(nodes: DataFrame) -> DataFrame:
    """type, count, is_semantic of all types met."""
    return nodes.groupBy("type").agg(F.count("*").alias("count")).withColumn("is_semantic", F.col("type").isin(*SEMANTIC_TYPES))
