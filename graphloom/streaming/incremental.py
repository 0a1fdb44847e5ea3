"""Summaries of nodes that arrive as files, with neighbours from edges that arrive too.

What has been seen is kept in the state store, not looked up in the output: a node's
first row goes on, later rows of its id do not. A batch's files bear its number, so that
a batch that is run again after a failure replaces what it wrote. So a batch's work grows with
its rows, not with what was written before.

Edges are a second stream, joined with the nodes they lead to: an edge whose other end is not
there yet waits in the state store. The best few neighbours of each node lie in a keyed table
that a batch changes in the buckets it falls into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.classify import classify
from graphloom.operators.graph import neighbor_edges
from graphloom.operators.summaries import NEIGHBORS, generate_summaries
from graphloom.schema import EDGE_SCHEMA, NODE_SCHEMA
from graphloom.sources.snapshots import Folder, Snapshots, bucket_of
from graphloom.sources.store import read_summaries, write_summaries

NEAR = T.StructType([T.StructField("me", T.StringType()), T.StructField("best", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("relationship", "nb", "direction", "name")])))])


def _files(spark: SparkSession, schema: T.StructType, path: str, per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def neighbour_stream(spark: SparkSession, node_dir: str, edge_dir: str, near: str, checkpoint: str, k: int = NEIGHBORS, per_batch: int | None = None, buckets: int = 64) -> StreamingQuery:
    """Keep the first k neighbours, by (relationship, id, direction), of each node in the keyed table at near."""
    nodes = _files(spark, NODE_SCHEMA, node_dir, per_batch).dropDuplicates(["id"]).select(F.col("id").alias("other"), "name")
    edges = _files(spark, EDGE_SCHEMA, edge_dir, per_batch).dropDuplicates(["source_id", "target_id", "relationship"])
    known = neighbor_edges(edges, "both").select("me", "relationship", "nb", "direction").join(nodes, F.col("nb") == F.col("other"))

    def step(batch: DataFrame, _: int) -> None:
        table = Snapshots(batch.sparkSession, near)
        base = table.manifest()
        entry = base["tables"].get("near") or {"folders": {}, "key": ["me"], "buckets": buckets}
        one = F.struct("relationship", "nb", "direction", "name")
        new = batch.groupBy("me").agg(F.slice(F.sort_array(F.collect_set(one)), 1, k).alias("best")).persist()
        try:
            old = near_of(table, entry, new.select("me")).select("me", F.col("best").alias("had"))
            both = F.slice(F.sort_array(F.array_distinct(F.concat("best", F.coalesce("had", F.array().cast(NEAR["best"].dataType))))), 1, k)
            done = table.merge("near", new.join(old, "me", "left").select("me", both.alias("best")), entry)
        finally:
            new.unpersist()
        if done is not entry:
            table.commit({"near": done}, base)
            table.expire()

    return known.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def near_of(table: Snapshots, entry: dict | None, ids: DataFrame) -> DataFrame:
    """me, best of some nodes (me); only the buckets that they fall into are read."""
    if not entry:
        return table.read_entry(None, NEAR)
    due = {str(r[0]) for r in ids.select(bucket_of(["me"], entry["buckets"])).distinct().collect()}  # at most as many as buckets
    return table.read_entry(entry | {"folders": {b: f for b, f in entry["folders"].items() if b in due}}, NEAR).join(ids, "me", "left_semi")


def put_batch(made: DataFrame, out: str, name: str) -> None:
    """Write a batch's summaries aside, and then give their files names that begin with its own."""
    folder = Folder(made.sparkSession, out)
    write_summaries(made, f"{out}/_{name}", "overwrite")
    for old in folder.names():
        if old.startswith(name):
            folder.delete(old)
    for part in folder.names(f"_{name}"):
        if part.startswith("part-"):
            folder.rename(f"_{name}/{part}", f"{name}-{part}")
    folder.delete(f"_{name}")


def summarise_stream(spark: SparkSession, node_dir: str, edges: DataFrame | str, out: str, checkpoint: str, style: str = "concise", per_batch: int | None = None) -> StreamingQuery:
    """Summarise node files as they appear, each id once.

    edges is a fixed table, whose ends are looked for among a batch's nodes, or the path of a table
    that neighbour_stream keeps. Ids that out had when the stream first began are skipped.
    """
    marks = Folder(spark, checkpoint)
    if "before" not in marks.names() and Folder(spark, out).names():
        read_summaries(spark, out).select("id").write.parquet(f"{checkpoint}/before")
    started = "before" in marks.names()

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        have = session.read.schema("id string").parquet(f"{checkpoint}/before") if started else None
        nodes = classify(batch)
        if isinstance(edges, str):
            table = Snapshots(session, edges)
            best = near_of(table, table.manifest()["tables"].get("near"), nodes.select(F.col("id").alias("me")))
            made = generate_summaries(nodes, None, style, have, near=best.select("me", F.transform("best", lambda x: x["name"]).alias("neighbors")))
        else:
            made = generate_summaries(nodes, edges, style, have)
        put_batch(made, out, f"batch-{number:09d}")

    stream = _files(spark, NODE_SCHEMA, node_dir, per_batch).dropDuplicates(["id"])
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
