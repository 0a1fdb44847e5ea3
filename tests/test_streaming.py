"""Streams of nodes and edges: each id once, neighbours as they come, batches that do not grow."""

from __future__ import annotations

import json


from graphloom.operators.classify import classify
from graphloom.operators.summaries import generate_summaries, node_context
from graphloom.schema import EDGE_SCHEMA, NODE_SCHEMA
from graphloom.sources.snapshots import Snapshots
from graphloom.sources.store import read_summaries, write_summaries
from graphloom.streaming.incremental import NEAR, neighbour_stream, summarise_stream


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def node(i, name=None):
    return (i, "function", name or i.upper(), "/a", "python", "{}")


def test_neighbours_wait_for_their_nodes(spark, tmp_path):
    n, e, near = tmp_path / "n", tmp_path / "e", str(tmp_path / "near")
    run = lambda: neighbour_stream(spark, str(n), str(e), near, str(tmp_path / "cp"), k=2, buckets=4).awaitTermination(120)
    best = lambda: {r["me"]: [x["name"] for x in r["best"]] for r in Snapshots(spark, near).read("near", NEAR).collect()}
    put(spark, n, [node("a"), node("d")], NODE_SCHEMA)
    put(spark, e, [("a", x, "calls", 1.0, "{}") for x in ("b", "c", "d")] + [("a", "a", "calls", 1.0, "{}")], EDGE_SCHEMA)
    run()
    assert best() == {"a": ["A", "D"], "d": ["A"], "b": ["A"], "c": ["A"]}
    put(spark, n, [node("b"), node("a", "again")], NODE_SCHEMA)  # a's row is not its first
    put(spark, e, [("a", "b", "calls", 1.0, "{}"), ("d", "b", "imports", 1.0, "{}")], EDGE_SCHEMA)
    run()
    assert best() == {"a": ["A", "B"], "d": ["A", "B"], "b": ["A", "D"], "c": ["A"]}
    nodes, edges = spark.read.parquet(str(n)).filter("name <> 'again'"), spark.read.parquet(str(e)).distinct()
    want = {r["id"]: r["neighbors"] for r in node_context(nodes, edges, 2).collect()}
    assert {i: best()[i] for i in want} == want


def test_streamed_summaries_equal_those_of_a_run(spark, tmp_path):
    n, e, out = tmp_path / "n", tmp_path / "e", str(tmp_path / "out")
    ids = [f"n{i}" for i in range(30)]
    put(spark, n, [node(i) for i in ids], NODE_SCHEMA)
    put(spark, e, [(ids[i], ids[i * 7 % 30], "calls", 1.0, "{}") for i in range(30)], EDGE_SCHEMA)
    neighbour_stream(spark, str(n), str(e), str(tmp_path / "near"), str(tmp_path / "cp1")).awaitTermination(120)
    summarise_stream(spark, str(n), str(tmp_path / "near"), out, str(tmp_path / "cp2"), "detailed").awaitTermination(120)
    want = generate_summaries(classify(spark.read.parquet(str(n))), spark.read.parquet(str(e)), "detailed")
    text = lambda df: sorted((r["id"], r["summary"]) for r in df.collect())
    assert text(read_summaries(spark, out)) == text(want)


def test_what_was_there_before_is_skipped_and_a_batch_run_again_adds_nothing(spark, tmp_path):
    n, out, edges = tmp_path / "n", str(tmp_path / "out"), spark.createDataFrame([], EDGE_SCHEMA)
    write_summaries(generate_summaries(classify(spark.createDataFrame([node("old")], NODE_SCHEMA)), edges), out)
    put(spark, n, [node("old"), node("new")], NODE_SCHEMA)
    for _ in range(2):
        summarise_stream(spark, str(n), edges, out, str(tmp_path / "cp")).awaitTermination(120)
    commits = sorted((tmp_path / "cp/commits").glob("[0-9]*"))
    for last in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        last.unlink()  # as if the run had died before its commit
    summarise_stream(spark, str(n), edges, out, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(json.loads(r["value"])["id"] for r in spark.read.text(out).select("value").collect()) == ["new", "old"]


def test_batches_do_not_grow_with_the_output(spark, tmp_path):
    n, out, edges = tmp_path / "n", str(tmp_path / "out"), spark.createDataFrame([], EDGE_SCHEMA)
    for b in range(20):
        put(spark, n, [node(f"n{b}-{i}") for i in range(300)] + [node(f"n{max(0, b - 1)}-{i}") for i in range(50)], NODE_SCHEMA)
    query = summarise_stream(spark, str(n), edges, out, str(tmp_path / "cp"), per_batch=1)
    query.awaitTermination(300)
    took = [p["durationMs"]["addBatch"] for p in query.recentProgress if p["numInputRows"]]
    assert len(took) == 20 and sum(took[-5:]) < 2 * sum(took[3:8]) + 1000
    assert read_summaries(spark, out).count() == spark.read.text(out).count() == 6000


def test_a_stream_needs_no_edges(spark, tmp_path):
    put(spark, tmp_path / "n", [node("a")], NODE_SCHEMA)
    summarise_stream(spark, str(tmp_path / "n"), str(tmp_path / "none"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r["id"] for r in read_summaries(spark, str(tmp_path / "out")).collect()] == ["a"]


