"""Bounded simple-path traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import GraphError
from graphloom.schema import RELATIONSHIPS
from graphloom.session import staged


def sink_distances(hop: DataFrame, max_depth: int) -> DataFrame:
    """at, need: the fewest edges from a node of hop (at, to) to a node without leaving edges, if at most max_depth.

    Searched backwards from the sinks, a level a join, each node labelled when it is met first.
    """
    level = staged(hop.select(F.col("to").alias("at")).distinct().join(hop.select("at"), "at", "left_anti").withColumn("need", F.lit(0)), "sinks")
    found = level
    for need in range(1, max_depth + 1):
        before = hop.join(level.select(F.col("at").alias("to")), "to", "left_semi").select("at").distinct()
        level = staged(before.join(found.select("at"), "at", "left_anti").withColumn("need", F.lit(need)), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def traverse_paths(starts: DataFrame | None, edges: DataFrame, relationship: str, max_depth: int = 3) -> DataFrame:
    """start, path, depth: all simple paths of at most max_depth edges that end at a sink.

    starts has a column id; None stands for every node with leaving edges. A path that depth
    or a cycle cuts off is dropped. A start without leaving edges gives the path of itself
    alone. max_depth < 0 gives none.

    A hop is taken only to nodes from which a sink can be reached with the edges that are
    left: their distances to the nearest sink are found first, and are a lower bound also for
    simple paths. So the frontier never holds a path that depth alone would cut off.

    Only inner nodes, with edges both ways, can be passed, and every other end of an edge is a
    sink. So the edges are dealt out once, to be distinct; the search back from the sinks and
    all hops but the first read the edges that leave inner nodes, and a path's last hop is
    told by what is not inner. Where few nodes are, these joins broadcast them. The frontier is
    written at each level, in the shared folder; finished paths are only in the result's plan.
    """
    if relationship not in RELATIONSHIPS:
        raise GraphError(f"Invalid relationship: {relationship}")
    hop = edges.filter(F.col("relationship") == relationship).select(F.col("source_id").alias("at"), F.col("target_id").alias("to")).distinct()
    if max_depth > 0:
        hop = staged(hop, "hops")
    sources = hop.select("at").distinct()
    alone = sources.limit(0) if starts is None else starts.select(F.col("id").alias("at")).join(sources, "at", "left_anti")
    if max_depth < 0:
        alone = alone.limit(0)
    done = alone.select(F.col("at").alias("start"), F.array("at").alias("path"))
    if max_depth > 0:
        inner = staged(hop.select(F.col("to").alias("at")).distinct().join(sources, "at", "left_semi"), "inner")
        first = hop.filter("at IS NOT NULL AND to IS NOT NULL")
        if starts is not None:
            first = first.join(starts.select(F.col("id").alias("at")), "at")
        first = first.withColumnRenamed("at", "start")
        begun = lambda df: df.select("start", F.col("to").alias("at"), F.array("start", "to").alias("path"))
        done = done.unionByName(begun(first.join(inner.select(F.col("at").alias("to")), "to", "left_anti")).drop("at"))
    if max_depth > 1:
        hop = staged(hop.join(inner, "at", "left_semi"), "inner_hops")
        need = sink_distances(hop, max_depth - 1).withColumnRenamed("at", "to")
        hop = staged(hop.join(need, "to"), "due_hops")
        front = begun(first.join(need.filter("need > 0"), "to").filter("start <> to"))
        for depth in range(2, max_depth + 1):
            front = staged(front, "front")
            if front.isEmpty():
                break
            last = front.join(hop.filter("need = 0"), "at")
            done = done.unionByName(last.select("start", F.array_append("path", F.col("to")).alias("path")))
            front = front.join(hop.filter(F.col("need").between(1, max_depth - depth)), "at").filter(~F.array_contains("path", F.col("to")))
            front = front.select("start", F.col("to").alias("at"), F.array_append("path", F.col("to")).alias("path"))
    return done.select("start", "path", (F.size("path") - 1).cast("bigint").alias("depth"))
