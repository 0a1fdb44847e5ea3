"""Places of rows in the order of their group, without a group meeting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.staging import few, partitions, stage


def numbered(table: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """table (staged, short rows) with place (from 0, in the order of its group) and width (rows of the group).

    Rows are dealt by ranges of (group, order), so a group of any size lies in as many
    partitions as it needs; a partition counts its rows of each group, and a prefix sum over
    these counts, as many as partitions and groups together, gives the rest. Nulls are a
    group, and come first in an order; rows that agree in all of it are numbered as they come.
    """
    spark = table.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in [*group, *order]]
    spread = table.withColumn("_tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(partitions(spark), *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    flat = stage(ranged.withColumn("_row", F.monotonically_increasing_id()), name)
    part = F.shiftright("_row", 33).alias("_part")
    counts = flat.groupBy(part, *group).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("width", F.sum("_n").over(whole))
    counts = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_first", "_before", "width")
    counts = few(stage(counts, f"{name}-counts"))
    same = F.shiftright("_row", 33) == F.col("_p")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return flat.join(counts, same).withColumn("place", F.col("_row") - F.col("_first") + F.col("_before")).select(*table.columns, "place", "width")
