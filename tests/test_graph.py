from __future__ import annotations

import random

import pytest

from graphloom.operators import graph, traverse
from graphloom.operators.classify import classification_counts, classify
from graphloom.operators.graph import GraphError

N = "id string, type string, name string, path string, lang string, properties string"
E = "source_id string, target_id string, relationship string, weight double, properties string"


@pytest.fixture()
def sample(spark):
    nodes = spark.createDataFrame(
        [("node1", "function", "test_func", "/test.py", "python", "{}"), ("node2", "class", "TestClass", "/test.py", "python", "{}"), ("node3", "file", "test.py", "/test.py", "python", "{}")], N
    )
    edges = spark.createDataFrame([("node1", "node3", "defined_in", 1.0, "{}"), ("node2", "node3", "defined_in", 1.0, "{}")], E)
    return nodes, edges


def test_add_edge_and_neighbours(spark, sample):
    nodes, edges = sample
    new = spark.createDataFrame([("node1", "node2", "calls", 2.0, '{"line": 42}')], E)
    edges = graph.add_edges(nodes, edges, new)
    out = graph.neighbors(nodes, edges, "outgoing", "calls", ["node1"]).collect()
    assert [(r["id"], r["edge"]["weight"], r["edge"]["properties"]) for r in out] == [("node2", 2.0, '{"line": 42}')]
    assert {r["id"] for r in graph.neighbors(nodes, edges, "incoming", of=["node3"]).collect()} == {"node1", "node2"}
    edges = graph.add_edges(nodes, edges, spark.createDataFrame([("node1", "node2", "calls", 5.0, None)], E))
    assert [r["weight"] for r in edges.filter("relationship = 'calls'").collect()] == [5.0]


def test_rejections(spark, sample):
    nodes, edges = sample
    with pytest.raises(GraphError, match="Invalid type"):
        graph.add_nodes(nodes, edges, spark.createDataFrame([("x", "planet", "x", None, None, "{}")], N))
    with pytest.raises(GraphError, match="Invalid relationship"):
        graph.add_edges(nodes, edges, spark.createDataFrame([("node1", "node2", "orbits", 1.0, "{}")], E))
    with pytest.raises(GraphError, match="Source node"):
        graph.add_edges(nodes, edges, spark.createDataFrame([("no", "neither", "calls", 1.0, "{}")], E))
    with pytest.raises(GraphError, match="Target node"):
        graph.add_edges(nodes, edges, spark.createDataFrame([("node1", "no", "calls", 1.0, "{}")], E))
    with pytest.raises(GraphError, match="direction"):
        graph.neighbor_edges(edges, "sideways")
    with pytest.raises(GraphError, match="relationship"):
        traverse.traverse_paths(nodes, edges, "orbits")


def test_replacing_a_node_drops_its_edges(spark, sample):
    nodes, edges = sample
    nodes, edges = graph.add_nodes(nodes, edges, spark.createDataFrame([("node1", "function", "renamed", None, None, None)], N))
    assert nodes.filter("id = 'node1'").first()["name"] == "renamed"
    assert [r["source_id"] for r in edges.collect()] == ["node2"]


def test_self_loop_labels(spark):
    e = spark.createDataFrame([("a", "a", "calls", 1.0, "{}")], E)
    for direction in ("outgoing", "incoming", "both"):
        assert [r["direction"] for r in graph.neighbor_edges(e, direction).collect()] == ["outgoing"]


def test_integrity(spark, sample):
    nodes, edges = sample
    assert graph.integrity_report(nodes, edges).first().asDict() == {"valid": True, "issues": ""}
    bad = nodes.unionByName(spark.createDataFrame([("bad", "invalid_type", "b", None, None, "{}")], N))
    report = graph.integrity_report(bad, edges).first()
    assert not report["valid"] and "invalid_type" in report["issues"]
    assert graph.get_stats(nodes, edges)["total_nodes"] == 3


def test_replay_equals_a_log_run_step_by_step(spark):
    rng, nlog, elog, want = random.Random(3), [], [], set()
    for case in range(40):
        nodes, live = set(), {}
        for seq in range(rng.randint(1, 25)):
            key = lambda i: f"{case}:{i}"
            if rng.random() < 0.4 or len(nodes) < 2:
                n = key(rng.randint(0, 4))
                nodes.add(n)
                nlog.append((n, seq))
                live = {k: v for k, v in live.items() if n not in k}
            else:
                s, t = rng.choice(sorted(nodes)), rng.choice(sorted(nodes))
                elog.append((s, t, "calls", seq))
                live[s, t] = seq
        want |= {(s, t, q) for (s, t), q in live.items()}
    _, edges = graph.replay(spark.createDataFrame(nlog, "id string, seq int"), spark.createDataFrame(elog, "source_id string, target_id string, relationship string, seq int"))
    assert {(r["source_id"], r["target_id"], r["seq"]) for r in edges.collect()} == want


def paths_by_search(start, out, depth, path=None):
    path = path or [start]
    if not out.get(start):
        return [path]
    if depth <= 0:
        return []
    return [p for n in sorted(out[start]) if n not in path for p in paths_by_search(n, out, depth - 1, [*path, n])]


@pytest.mark.parametrize("depth", [0, 2, 4])
def test_paths_equal_depth_first_search(spark, depth):
    rng, edges, starts, want = random.Random(5), [], [], []
    for case in range(30):
        out: dict = {}
        ids = [f"{case}:{i}" for i in range(6)]
        for _ in range(rng.randint(0, 9)):
            a, b = rng.choice(ids), rng.choice(ids)
            out.setdefault(a, set()).add(b)
        edges += [(a, b, "calls", 1.0, "{}") for a, bs in out.items() for b in bs]
        starts += [(i,) for i in ids]
        want += [p for i in ids for p in paths_by_search(i, out, depth)]
    got = traverse.traverse_paths(spark.createDataFrame(starts, "id string"), spark.createDataFrame(edges, E), "calls", depth)
    assert sorted(tuple(r["path"]) for r in got.collect()) == sorted(map(tuple, want))


def test_negative_depth_gives_nothing(spark):
    assert traverse.traverse_paths(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], E), "calls", -1).count() == 0


TYPES = [
    ("file", "test.py", "module"), ("class", "ValueError", "error"), ("class", "DefaultConfig", "error"), ("class", "UserModel", "concept"),
    ("function", "main", "recipe"), ("function", "maintain", "recipe"), ("function", "test_x", "recipe"), ("function", "run", "recipe"), ("function", "runner", "capability"),
    ("function", "_helper", "concept"), ("function", "__init__", "concept"), ("function", "process_data", "capability"), ("variable", "x", "concept"), ("external", "h", "external"), ("concept", "c", "concept"),
]


def test_classification_and_its_repeat(spark):
    df = spark.createDataFrame([(str(i), t, n, None, None, "{}") for i, (t, n, _) in enumerate(TYPES)], N)
    once = classify(df)
    assert [r["type"] for r in once.orderBy(once.id.cast("int")).collect()] == [w for *_, w in TYPES]
    assert sorted(map(tuple, classify(once).collect())) == sorted(map(tuple, once.collect()))
    counts = {r["type"]: r["count"] for r in classification_counts(classify(df.limit(0))).collect()}
    assert counts == dict.fromkeys(["module", "capability", "concept", "error", "recipe"], 0)


def test_neighbours_that_are_no_nodes_take_no_place(spark):
    nodes = spark.createDataFrame([(i, "function", i.upper(), None, None, "{}") for i in ("a", "m", "z")], N)
    edges = spark.createDataFrame([("a", f"gone{k}", "calls", 1.0, "{}") for k in range(6)] + [("a", "z", "calls", 1.0, "{}"), ("m", "a", "throws", 1.0, "{}")], E)
    got = {r["me"]: r["neighbors"] for r in graph.first_neighbors(nodes, edges, 5).collect()}
    assert got["a"] == ["Z", "M"] and got["z"] == ["A"]


def test_repeated_keys_of_added_rows(spark):
    nodes = spark.createDataFrame([("a", "function", "a", None, None, "{}"), ("b", "function", "b", None, None, "{}")], N)
    edges = spark.createDataFrame([], E)
    twice = spark.createDataFrame([("a", "function", "one", None, None, "{}", 1), ("a", "class", "two", None, None, "{}", 2)], N + ", seq int")
    got, _ = graph.add_nodes(nodes, edges, twice)
    assert sorted((r["id"], r["name"]) for r in got.collect()) == [("a", "two"), ("b", "b")]
    with pytest.raises(graph.GraphError, match="Repeated key"):
        graph.add_nodes(nodes, edges, twice.drop("seq"))
    calls = spark.createDataFrame([("a", "b", "calls", 1.0, "{}", 1), ("a", "b", "calls", 2.0, "{}", 2)], E + ", seq int")
    assert [r["weight"] for r in graph.add_edges(nodes, edges, calls).collect()] == [2.0]
    with pytest.raises(graph.GraphError, match="Repeated key"):
        graph.add_edges(nodes, edges, calls.drop("seq"))


def test_paths_end_before_a_sink_is_reached_or_a_cycle_closes(spark):
    edges = spark.createDataFrame([(a, b, "calls", 1.0, "{}") for a, b in (("x", "y"), ("y", "x"), ("y", "z"), ("p", "q"), ("q", "p"))], E)
    got = traverse.traverse_paths(spark.createDataFrame([(i,) for i in "xyzpq"], "id string"), edges, "calls", 3)
    assert sorted(">".join(r["path"]) for r in got.collect()) == ["x>y>z", "y>z", "z"]


def test_the_frontier_holds_only_paths_that_can_still_end(spark, monkeypatch):
    """A full graph of 9 nodes has no end within reach but through one: 10^5 simple prefixes, few paths."""
    nodes = [f"n{i}" for i in range(9)]
    edges = [(a, b, "calls", 1.0, "{}") for a in nodes for b in nodes if a != b] + [("n0", "tail1", "calls", 1.0, "{}"), ("tail1", "tail2", "calls", 1.0, "{}"), ("tail2", "end", "calls", 1.0, "{}"), ("lone", "lone2", "calls", 1.0, "{}"), ("lone2", "lone", "calls", 1.0, "{}")]
    out = {}
    for a, b, *_ in edges:
        out.setdefault(a, set()).add(b)
    starts = [*nodes, "tail1", "end", "lone"]
    frame = spark.createDataFrame(edges, E)
    hop = frame.select(frame.source_id.alias("at"), frame.target_id.alias("to"))
    assert {r["at"]: r["need"] for r in traverse.sink_distances(hop, 5).collect()} == {"end": 0, "tail2": 1, "tail1": 2, "n0": 3} | {f"n{i}": 4 for i in range(1, 9)}
    for depth in (3, 4, 5):
        got = traverse.traverse_paths(spark.createDataFrame([(i,) for i in starts], "id string"), frame, "calls", depth)
        want = [p for i in starts for p in paths_by_search(i, out, depth)]
        assert sorted(tuple(r["path"]) for r in got.collect()) == sorted(map(tuple, want))


def shuffled_rows(spark, after: int = -1) -> tuple[int, int]:
    """Rows that stages later than `after` have written to shuffles, and the last stage so far; the session forgets old ones."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    nothing = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, nothing, spark._jvm.java.util.ArrayList())
    rows = {(x := stages.apply(i)).stageId(): x.shuffleWriteRecords() for i in range(stages.size())}
    return sum(n for k, n in rows.items() if k > after), max(rows, default=after)


def test_edges_to_sinks_are_dealt_out_once(spark):
    """However deep the search, edges that end at a sink and leave a node that nothing leads to pass no second shuffle."""
    calls = [(f"p{i}", f"s{i * k % 97}") for i in range(1000) for k in range(1, 21)]
    calls = sorted({*calls, *((f"n{i}", f"n{i + 1}") for i in range(7)), ("n7", "s0"), ("p0", "n2"), ("c1", "c2"), ("c2", "c1"), ("p1", "c1")})
    edges = spark.createDataFrame([(a, b, "calls", 1.0, "{}") for a, b in calls], E).coalesce(1)
    starts, out = sorted({a for a, _ in calls}), {}
    for a, b in calls:
        out.setdefault(a, set()).add(b)
    _, last = shuffled_rows(spark)
    got = traverse.traverse_paths(spark.createDataFrame([(i,) for i in starts], "id string"), edges, "calls", 8).collect()
    rows, last = shuffled_rows(spark, last)
    assert sorted(tuple(r["path"]) for r in got) == sorted(tuple(p) for i in starts for p in paths_by_search(i, out, 8))
    assert rows < 3 * len(calls)
    again = traverse.traverse_paths(None, edges, "calls", 8).collect()
    rows, _ = shuffled_rows(spark, last)
    assert 0 < rows < 2 * len(calls) and sorted(again) == sorted(got)


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_paths_without_broadcasts_repeated_edges_and_ends_that_are_null(spark, depth):
    rng = random.Random(depth)
    calls = [(rng.choice("abcdefgh"), rng.choice("abcdefghxyz")) for _ in range(25)]
    out = {}
    for a, b in calls:
        out.setdefault(a, set()).add(b)
    edges = spark.createDataFrame([(a, b, "calls", 1.0, "{}") for a, b in [*calls, *calls, ("a", None), (None, "x"), ("k", None)]], E)
    want = sorted(tuple(p) for i in sorted(out) for p in paths_by_search(i, out, depth))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for starts in (None, spark.createDataFrame([(i,) for i in sorted(out)], "id string")):
            got = traverse.traverse_paths(starts, edges, "calls", depth).collect()
            assert sorted(tuple(r["path"]) for r in got) == want and all(r["depth"] == len(r["path"]) - 1 for r in got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_writes_of_one_moment_are_decided_alike(spark):
    log = [("a", i, 5, None if i % 2 else "x") for i in range(8)] + [("a", 99, 4, "y"), ("b", 1, None, "z")]
    for parts in (1, 3, 7):
        got = graph.upsert_nodes(spark.createDataFrame(log, "id string, name int, seq int, path string").repartition(parts))
        assert got.columns == ["id", "name", "seq", "path"] and sorted(map(tuple, got.collect())) == [("a", 7, 5, None), ("b", 1, None, "z")]
