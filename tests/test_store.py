"""Versions of the store: crashes, conflicts, expiry, merges, rejects."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.operators import vectors
from graphloom.operators.graph import GraphError
from graphloom.operators.summaries import generate_summaries
from graphloom.schema import EDGE_SCHEMA, NODE_SCHEMA, SUMMARY_SCHEMA
from graphloom.sources import store as stores
from graphloom.sources.snapshots import Conflict, Snapshots


def graph_of(spark, *names):
    nodes = spark.createDataFrame([(n, "function", n, "/a.py", "python", "{}") for n in names], NODE_SCHEMA)
    edges = spark.createDataFrame([(a, b, "calls", 1.0, "{}") for a, b in zip(names, names[1:], strict=False)], EDGE_SCHEMA)
    return nodes, edges


def seen(store):
    return sorted(r["id"] for r in store.nodes().collect()), sorted((r["source_id"], r["target_id"]) for r in store.edges().collect())


@pytest.fixture()
def store(spark, tmp_path):
    return stores.GraphStore(spark, str(tmp_path / "graph"))


def test_a_run_that_dies_between_the_tables_leaves_the_old_graph(spark, store, monkeypatch):
    assert seen(store) == ([], []) and store.version == 0
    store.write(*graph_of(spark, "a", "b"))
    want, put = seen(store), Snapshots.write

    def die(self, name, df, partition_by=()):
        if name == "edges":
            raise OSError("lost")
        return put(self, name, df, partition_by)

    monkeypatch.setattr(Snapshots, "write", die)
    with pytest.raises(OSError, match="lost"):
        store.write(*graph_of(spark, "x", "y", "z"))
    monkeypatch.undo()
    assert seen(store) == want and store.version == 1
    assert store.expire() == 1 and seen(store) == want  # the nodes that were written aside
    store.write(*graph_of(spark, "x", "y", "z"))
    assert seen(store)[0] == ["x", "y", "z"] and store.version == 2


def test_a_snapshot_stays_while_others_write_and_expires_later(spark, store):
    store.write(*graph_of(spark, "a", "b"))
    old = store.snapshot()
    store.write(*graph_of(spark, "c"))
    assert seen(old) == (["a", "b"], [("a", "b")]) and old.version == 1 and seen(store)[0] == ["c"]
    with pytest.raises(GraphError, match="read only"):
        old.write(*graph_of(spark, "d"))
    store.write(*graph_of(spark, "d"))
    assert store.expire(keep=2) == 2 and store.tables.versions() == [2, 3]
    assert seen(store.snapshot(2))[0] == ["c"] and seen(store)[0] == ["d"]


def test_the_second_of_two_writers_is_refused(spark, store):
    store.write(*graph_of(spark, "a"))
    base = store.tables.manifest()
    store.write(*graph_of(spark, "b"))
    with pytest.raises(Conflict):
        store.tables.commit({"nodes": {"folders": {}}}, base)
    assert seen(store)[0] == ["b"] and not [n for n in store.tables.folder.names("manifests") if n.startswith("_")]


def test_times_and_keys(spark, store):
    store.write(*graph_of(spark, "a", "b", "c"), at="2020-01-01 00:00:00")
    store.upsert(graph_of(spark, "b", "d")[0], spark.createDataFrame([("b", "d", "calls", None, None)], EDGE_SCHEMA), at="2021-01-01 00:00:00")
    assert {r["id"]: r["created_at"].year for r in store.nodes(True).collect()} == {"a": 2020, "b": 2021, "c": 2020, "d": 2021}
    assert [(r["source_id"], r["target_id"], r["weight"], r["created_at"].year) for r in store.edges(True).collect()] == [("b", "d", 1.0, 2021)]
    nodes, edges = graph_of(spark, "a", "b")
    with pytest.raises(GraphError, match="Repeated key in nodes: a"):
        store.write(nodes.unionByName(nodes.limit(1)), edges)
    with pytest.raises(GraphError, match="Repeated key in edges"):
        store.write(nodes, edges.unionByName(edges))
    with pytest.raises(GraphError, match="Invalid type"):
        store.upsert(nodes.withColumn("type", F.lit("planet")), edges)
    assert store.version == 2


def test_merge_rewrites_only_the_buckets_of_new_rows(spark, store):
    row = lambda i, text: (i, "function", i, text, None, None)
    frame = lambda *rows: spark.createDataFrame(list(rows), SUMMARY_SCHEMA)
    store.merge_summaries(frame(*[row(f"n{i}", "first") for i in range(200)]), 8)
    before = store.tables.manifest()["tables"]["summaries"]["folders"]
    store.merge_summaries(frame(row("n7", "again"), row("new", "first")))
    after = store.tables.manifest()["tables"]["summaries"]["folders"]
    assert 1 <= sum(before.get(b) != d for b, d in after.items()) <= 2 and len(before) == 8
    text = {r["id"]: r["summary"] for r in store.summaries().collect()}
    assert len(text) == 201 and text["n7"] == "again" and text["n8"] == "first"
    assert store.merge_summaries(frame()) == store.version == 2
    with pytest.raises(ValueError, match="Repeated key: n1"):
        store.merge_summaries(frame(row("n1", "x"), row("n1", "y")))
    assert store.version == 2 and not [n for n in store.tables.folder.names("data/summaries") if n.startswith("incoming") and store.expire() < 0]


def test_embeddings_are_made_once_and_failures_stay_null(spark, store):
    store.merge_summaries(generate_summaries(*graph_of(spark, *[f"f{i}" for i in range(40)])), 4)

    def failing():
        encode = vectors.hashing_encoder(8)()

        def model(texts):
            if any("'f3'" in t for t in texts):
                raise RuntimeError("no memory")
            return encode(texts)

        return model

    embed = lambda load: lambda rows: vectors.embed_summaries(rows, load, batch=1)
    first = store.embed_summaries(embed(failing))
    made = {r["id"]: r["embedding"] for r in store.summaries().collect()}
    assert len(made) == 40 and 0 < sum(v is None for v in made.values()) < 40 and made["f5"]
    assert store.embed_summaries(embed(failing)) == first
    store.embed_summaries(embed(vectors.hashing_encoder(8)))
    again = {r["id"]: r["embedding"] for r in store.summaries().collect()}
    assert all(again.values()) and all(again[i] == v for i, v in made.items() if v)


def test_lines_that_cannot_be_read_are_counted(spark, tmp_path):
    good = [f'{{"id": "n{i}", "summary": "s", "extra": 1}}' for i in range(5)]
    bad = ["{cut", '"text"', '{"summary": "no id"}', '{"id": null}', '{"id": "x", "embedding": "no list"}', "[1, 2]"]
    (tmp_path / "a.json").write_text("\n".join([*good, "", "   ", good[0], *bad]))
    rejected = stores.rejected_summaries(spark, str(tmp_path)).collect()
    assert stores.read_summaries(spark, str(tmp_path)).count() == 5
    assert sorted(r["line"] for r in rejected) == sorted(bad) and {r["reason"] for r in rejected if "summary" in r["line"]} == {"no id"}
    assert all(r["file"].endswith("a.json") for r in rejected)
    (tmp_path / "i").mkdir()
    (tmp_path / "i/x").write_text('{"messages": [{"role": "user", "content": "q"}], "metadata": {}}\n{"messages": \n{}\n')
    assert stores.rejected_instructions(spark, str(tmp_path / "i")).count() == 2 and stores.read_instructions(spark, str(tmp_path / "i")).filter("messages IS NOT NULL").count() == 1
