"""Graph store operators: upserts, neighbours, statistics, integrity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import NODE_TYPES, RELATIONSHIPS


class GraphError(ValueError):
    """A write or a call that the data model forbids."""


# --- mutation -------------------------------------------------------------


def last_write(log: DataFrame, key: list[str]) -> DataFrame:
    """The row of each key with the largest seq; of rows that agree in it, the largest in all columns, so that reruns agree.

    The maximum combines on the map side, so a hot key costs one row per task.
    """
    rest = [c for c in log.columns if c not in key]
    others = [c for c in rest if c != "seq"]
    return log.groupBy(*key).agg(F.max(F.struct("seq", *others)).alias("last")).select(*key, *[F.col("last")[c].alias(c) for c in rest])


def upsert_nodes(log: DataFrame) -> DataFrame:
    """Last write of each node. log: id, seq and the node's other columns."""
    return last_write(log, ["id"])


def upsert_edges(log: DataFrame) -> DataFrame:
    """Last write of each (source_id, target_id, relationship). log: these, seq and other columns."""
    return last_write(log, ["source_id", "target_id", "relationship"])


def replay(node_log: DataFrame, edge_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State after a log of replacing writes in which a node's write deletes its edges.

    An edge stays iff its last write comes after the last write of both its ends.
    An edge whose end was never written is dropped, as a foreign key would.
    """
    nodes = upsert_nodes(node_log)
    edges = upsert_edges(edge_log)
    at = nodes.select(F.col("id").alias("_n"), F.col("seq").alias("_s"))
    for end in ("source_id", "target_id"):
        edges = edges.join(at, (F.col(end) == F.col("_n")) & (F.col("seq") > F.col("_s")), "left_semi")
    return nodes, edges


def add_nodes(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace or add nodes by id; edges at replaced nodes go.

    Of rows of new that repeat an id the one with the largest seq counts; without a column
    seq nothing tells which is last, and a repeated id raises.
    """
    check_vocabulary(new, "type", NODE_TYPES)
    new = last_of(new, ["id"], upsert_nodes)
    new = new.withColumn("properties", F.coalesce("properties", F.lit("{}")))
    ids = new.select("id")
    kept = nodes.join(ids, "id", "left_anti").unionByName(new, allowMissingColumns=True)
    for end in ("source_id", "target_id"):
        edges = edges.join(ids, F.col(end) == F.col("id"), "left_anti")
    return kept, edges


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Replace or add edges by their three keys, after checks of vocabulary and ends; repeated keys as in add_nodes."""
    check_vocabulary(new, "relationship", RELATIONSHIPS)
    for end, word in (("source_id", "Source"), ("target_id", "Target")):
        if missing := new.join(nodes, new[end] == nodes["id"], "left_anti").select(end).head(1):
            raise GraphError(f"{word} node does not exist: {missing[0][0]}")
    key = ["source_id", "target_id", "relationship"]
    new = last_of(new, key, upsert_edges).withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("properties", F.coalesce("properties", F.lit("{}")))
    return edges.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def last_of(new: DataFrame, key: list[str], upsert: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """new with one row a key: the last by seq, or as it is if no key is repeated."""
    if "seq" in new.columns:
        return upsert(new).drop("seq")
    if twice := new.groupBy(*key).count().filter("count > 1").head(1):
        raise GraphError(f"Repeated key without seq: {', '.join(map(str, twice[0][:-1]))}")
    return new


def check_vocabulary(df: DataFrame, column: str, allowed: list[str]) -> None:
    """Raise GraphError for a value outside the vocabulary (null is outside)."""
    if bad := df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(column).head(1):
        raise GraphError(f"Invalid {column}: {bad[0][0]}")


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """External nodes for edge targets that no node has; the name is the id."""
    return (
        edges.select(F.col("target_id").alias("id"))
        .join(nodes.select("id"), "id", "left_anti")
        .distinct()
        .select(
            "id",
            F.lit("external").alias("type"),
            F.col("id").alias("name"),
            F.lit(None).cast("string").alias("path"),
            F.lit(None).cast("string").alias("lang"),
            F.lit('{"placeholder": true}').alias("properties"),
        )
    )


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


# --- neighbours -----------------------------------------------------------


def neighbor_edges(edges: DataFrame, direction: str = "outgoing", relationship: str | None = None) -> DataFrame:
    """me, nb, direction, relationship, weight, properties for each edge seen from its end(s).

    A self-loop appears once under every direction and is labelled outgoing. Both
    directions come from one pass over the edges, each giving two rows.
    """
    if direction not in ("outgoing", "incoming", "both"):
        raise GraphError(f"Invalid direction: {direction}")
    if relationship:
        edges = edges.filter(F.col("relationship") == relationship)
    rest = ["relationship", "weight", "properties"]
    loop = F.col("source_id") == F.col("target_id")
    seen = lambda me, nb, label: F.struct(F.col(me).alias("me"), F.col(nb).alias("nb"), label.alias("direction"))
    out = seen("source_id", "target_id", F.lit("outgoing"))
    into = seen("target_id", "source_id", F.when(loop, "outgoing").otherwise("incoming"))
    if direction == "both":
        return edges.select(F.explode(F.when(loop, F.array(out)).otherwise(F.array(out, into))).alias("x"), *rest).select("x.*", *rest)
    return edges.select((out if direction == "outgoing" else into).alias("x"), *rest).select("x.*", *rest)


def neighbors(nodes: DataFrame, edges: DataFrame, direction: str = "outgoing", relationship: str | None = None, of: list[str] | None = None) -> DataFrame:
    """Neighbour rows: node columns of the neighbour and the edge; of narrows to some nodes."""
    seen = neighbor_edges(edges, direction, relationship)
    if of is not None:
        seen = seen.filter(F.col("me").isin(*of))
    edge = F.struct("relationship", "weight", F.col("e_properties").alias("properties"), "direction").alias("edge")
    return seen.withColumnRenamed("properties", "e_properties").join(nodes, F.col("nb") == F.col("id")).select("me", *nodes.columns, edge)


def first_neighbors(nodes: DataFrame, edges: DataFrame, k: int, only: DataFrame | None = None) -> DataFrame:
    """me, neighbors: the names of the first k neighbours by (relationship, id, direction).

    only (a column id) narrows to some nodes; edges of others are then left out first.
    Ends that no node has take no place. Only the k best (relationship, id, direction) of
    each node reach the join with names; the rank filter is pushed into a per-partition
    group limit.
    """
    seen = neighbor_edges(edges, "both").select("me", "relationship", "nb", "direction")
    if only is not None:
        seen = seen.join(only.select(F.col("id").alias("me")), "me", "left_semi")
    seen = seen.join(nodes.select(F.col("id").alias("nb")), "nb", "left_semi")
    w = Window.partitionBy("me").orderBy("relationship", "nb", "direction")
    top = seen.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    named = top.join(nodes.select(F.col("id").alias("nb"), "name"), "nb")
    ordered = F.array_sort(F.collect_list(F.struct("r", "name")))
    return named.groupBy("me").agg(F.transform(ordered, lambda x: x["name"]).alias("neighbors"))


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with edge_count, the number of edges that leave them; edges are counted before the join."""
    counts = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("target_id").alias("edge_count"))
    return nodes.join(counts, "id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))


def out_degree_topk(nodes: DataFrame, edges: DataFrame, k: int, types: list[str]) -> DataFrame:
    """The k nodes of the types with most leaving edges; ties by id."""
    return out_degree(nodes.filter(F.col("type").isin(*types)), edges).orderBy(F.desc("edge_count"), "id").limit(k)


# --- statistics and integrity --------------------------------------------


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total nodes and edges, distinct types and relationships."""
    n = nodes.agg(F.count("*").alias("total_nodes"), F.count_distinct("type").alias("unique_node_types"))
    e = edges.agg(F.count("*").alias("total_edges"), F.count_distinct("relationship").alias("unique_relationships"))
    return n.join(e)  # one row each


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage (2 digits) of each value, most frequent first."""
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))  # over the few counted rows
    return (
        df.groupBy(column)
        .agg(F.count("*").alias("count"))
        .withColumn("percentage", F.round(F.lit(100.0) * F.col("count") / total, 2))
        .orderBy(F.desc("count"), column)
    )


def get_stats(nodes: DataFrame, edges: DataFrame) -> dict:
    """Statistics as a driver-side record (a few rows)."""
    stats = graph_stats(nodes, edges).first().asDict()
    stats["node_types"] = [r.asDict() for r in distribution(nodes, "type").collect()]
    stats["relationships"] = [r.asDict() for r in distribution(edges, "relationship").collect()]
    return stats


def invalid_vocabulary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, value: node types and relationships outside the vocabularies."""
    n = nodes.filter(~F.col("type").isin(*NODE_TYPES)).select(F.lit("node_type").alias("kind"), F.col("type").alias("value"))
    e = edges.filter(~F.col("relationship").isin(*RELATIONSHIPS)).select(F.lit("relationship").alias("kind"), F.col("relationship").alias("value"))
    return n.unionByName(e).distinct()


def orphan_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with at least one end that no node has."""
    ids = nodes.select("id")
    lost = [edges.join(ids, edges[end] == ids["id"], "left_anti") for end in ("source_id", "target_id")]
    return lost[0].unionByName(lost[1]).dropDuplicates(["source_id", "target_id", "relationship"])


def integrity_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: valid, and issues as one text joined by '; '."""
    bad = invalid_vocabulary(nodes, edges).groupBy().agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "node_type", F.col("value")))), ", ").alias("types"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "relationship", F.col("value")))), ", ").alias("rels"),
    )
    lost = orphan_edges(nodes, edges).agg(F.count("*").alias("orphans"))
    issues = F.concat_ws(
        "; ",
        F.when(F.col("types") != "", F.concat(F.lit("Invalid node types: "), "types")),
        F.when(F.col("rels") != "", F.concat(F.lit("Invalid relationships: "), "rels")),
        F.when(F.col("orphans") > 0, F.concat(F.lit("Orphaned edges: "), F.col("orphans").cast("string"))),
    )
    return bad.join(lost).select((issues == "").alias("valid"), issues.alias("issues"))
