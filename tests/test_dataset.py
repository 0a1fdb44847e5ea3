from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import instruct, qa, summaries, validate, vectors
from graphloom.operators.inference import QueryClient, ask
from graphloom.sources import store
from tests.test_graph import E, N

LONG = "word " * 60


def lines(spark, *rows):
    return validate.parse_examples(spark.createDataFrame([(i, json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(rows)], "pos bigint, value string"))


def example(**kw):
    return {"id": "test_001", "type": "discovery", "prompt": "What?", "response": LONG, "refs": ["node1"]} | kw


def issues(spark, row, **kw):
    return validate.validate_examples(lines(spark, row), **kw).first()["issues"]


def test_example_checks(spark):
    assert issues(spark, example()) == []
    no = example()
    del no["response"]
    assert issues(spark, no) == ["Missing required field: response"]
    assert issues(spark, example(prompt="   ")) == ["Empty prompt"]
    assert issues(spark, example(response="Short answer.")) == ["Response too short: 3 tokens (min: 50)"]
    assert issues(spark, example(response="a b c d e")) == ["Response too short: 6 tokens (min: 50)"]  # 6.5, half to even
    assert issues(spark, example(response=LONG + "[TODO]")) == ["Contains placeholder: [TODO]", "Contains placeholder: TODO"]
    assert issues(spark, example(refs=[])) == ["refs list is empty"]
    assert issues(spark, example(refs="node1")) == ["refs must be a list"]
    assert issues(spark, example(type="invalid_type")) == ["Invalid type: invalid_type"]
    assert issues(spark, example(prompt=None)) == ["Empty prompt"]  # a null is a value, not a missing key


def test_unicode_spaces_part_words(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(scalar.word_count("t")).collect()] == [3, 0, 0]


def test_references_and_duplicates(spark):
    x = lines(spark, example(id="1", refs=["a", "b"]), example(id="2", refs=["c"], prompt="Other"), example(id="1", refs=["no"], prompt=" OTHER "))
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    checked = validate.reference_check(x, nodes)
    assert (checked.filter("ok").count(), checked.filter("not ok").count()) == (3, 1)
    assert sorted(map(tuple, validate.duplicates(x, "pos").collect())) == [("id", "1"), ("prompt", "1")]
    report = validate.dataset_report(x, nodes, order="pos").first()
    assert report["duplicates"] == 2 and report["invalid_refs"] == 1 and not report["is_valid"] and validate.gate(spark.createDataFrame([report]))


@pytest.fixture()
def graph(spark):
    nodes = spark.createDataFrame(
        [("cap1", "capability", "process_data", "/t.py", "python", '{"start_line": 3, "end_line": 9, "flag": true, "rate": 1.0, "list": [1], "none": null}'), ("cap2", "capability", "validate_input", None, None, "{}"),
         ("err", "error", "ValueError", "/t.py", "python", '{"start_line": 0}'), ("rec", "recipe", "main", "/t.py", "python", '{"start_line": 4}'), ("bad", "concept", "b", "/t.py", "python", '{"end_line": 4}')], N
    )
    edges = spark.createDataFrame([("cap1", "cap2", "calls", 1.0, "{}"), ("rec", "err", "throws", 1.0, "{}")], E)
    return nodes, edges


def test_summaries(spark, graph):
    text = {s: {r["id"]: r["summary"] for r in summaries.generate_summaries(*graph, s).collect()} for s in ("concise", "detailed", "anything")}
    assert "bad" not in text["concise"]  # an end without a start
    assert "None" in text["concise"]["cap2"] and "See also: process_data." in text["concise"]["cap2"]
    assert "It takes up lines 3-9." in text["detailed"]["cap1"] and "starts on" not in text["detailed"]["err"] and "It starts on line 4." in text["detailed"]["rec"]
    assert text["anything"]["cap1"].endswith("start_line: 3 | end_line: 9 | flag: True | rate: 1.0")


def test_incremental_run_adds_nothing(spark, graph):
    first = summaries.generate_summaries(*graph)
    assert summaries.generate_summaries(*graph, existing=first).count() == 0
    stats = summaries.summary_stats(first).first()
    assert stats["total_summaries"] == 4 and stats["min_tokens"] > 0


def test_questions(spark, graph):
    nodes, edges = graph
    m = summaries.generate_summaries(nodes, edges, "detailed")
    found = qa.generate_all(nodes, edges, m, dict.fromkeys(["discovery", "explain", "howto", "diagnostics"], 5), 2)
    rows = [r.asDict() for r in found.collect()]
    positive = [r for r in rows if "_neg_" not in r["id"]]
    assert len(rows) == 3 * len(positive) and {r["type"] for r in rows} == {"discovery", "explain", "howto", "diagnostics"}
    assert any("raises it: main." in r["response"] for r in positive)
    assert all(json.loads(r["metadata"]) for r in rows)
    none = next(json.loads(r["metadata"]) for r in rows if r["refs"] == ["cap2"] and r["type"] == "discovery" and "_neg_" not in r["id"])
    assert none["file"] is None  # the key stays with a null
    assert sorted(map(str, found.collect())) == sorted(map(str, qa.generate_all(nodes, edges, m, dict.fromkeys(["discovery", "explain", "howto", "diagnostics"], 5), 2).collect()))
    own = qa.negatives(qa.discovery(nodes, m, 5), nodes, m, 2, exclude_self=True).select("id", F.col("refs")[0].alias("ref")).collect()
    assert len(own) == 4


def test_round_trip_of_files(spark, graph, tmp_path):
    nodes, edges = graph
    m = summaries.generate_summaries(nodes, edges)
    store.write_summaries(m, str(tmp_path / "s"))
    assert store.read_summaries(spark, str(tmp_path / "s")).count() == 4
    x = instruct.to_instruction(qa.discovery(nodes, m, 5))
    store.write_instructions(x, str(tmp_path / "i"))
    back = store.read_instructions(spark, str(tmp_path / "i")).collect()
    assert [len(r["messages"]) for r in back] == [3, 3] and all(json.loads(r["metadata"])["id"] for r in back)
    parsed = store.read_examples(spark, str(tmp_path / "i"))
    assert [i for r in validate.validate_examples(parsed, 1).collect() for i in r["issues"]] == []
    g = store.GraphStore(spark, str(tmp_path / "g"))
    g.write(nodes, edges)
    assert sorted(map(str, g.nodes().collect())) == sorted(map(str, nodes.collect()))


def test_chat_split_tokens(spark):
    df = spark.createDataFrame([(i, [("user", "hi"), ("tool", "x"), ("assistant", "yo")]) for i in range(10)], "id bigint, messages array<struct<role:string,content:string>>")
    assert df.select(instruct.chatml(F.col("messages"))).first()[0] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>"
    sizes = {r["split"]: r["count"] for r in instruct.exact_split(df, "id", 0.2).groupBy("split").count().collect()}
    assert sizes == {"train": 8, "validation": 2}
    assert {r["split"] for r in instruct.exact_split(df, "id", 0).collect()} == {"train"}
    t = instruct.tokenize(spark.createDataFrame([("a b c",), (None,)], "t string"), "t", lambda: lambda s: list(range(1, len(s.split()) + 1)), 2).collect()
    assert t[0]["input_ids"] == [1, 2] and t[1]["input_ids"] == [0, 0] and t[1]["attention_mask"] == [0, 0] and t[0]["labels"] == [1, 2]
    assert [len(b) for b in instruct.batches(df, 4)] == [4, 4, 2]


def test_vectors(spark, graph):
    m = vectors.embed_summaries(summaries.generate_summaries(*graph), vectors.hashing_encoder(16))
    best = vectors.search_similar(m, m.filter("id = 'cap1'").first()["summary"], vectors.hashing_encoder(16)(), 2).collect()
    assert best[0]["id"] == "cap1" and abs(best[0]["similarity"] - 1) < 1e-6
    zero = spark.createDataFrame([("z", [0.0, 0.0]), ("a", [1.0, 0.0])], "id string, embedding array<float>")
    assert [r["id"] for r in vectors.cosine_topk(zero, [1.0, 0.0], 5).collect()] == ["a"]


def test_client(spark):
    def post(url, body, timeout):
        if "bad" in body["messages"][1]["content"]:
            raise OSError("down")
        return {"choices": [{"message": {"content": "fine"}}], "usage": {"n": 1}}

    rows = {r["question"]: r for r in ask(spark.createDataFrame([("good",), ("bad",)], "question string"), lambda: QueryClient("http://h/", post=post)).collect()}
    assert rows["good"]["answer"] == "fine" and rows["bad"]["answer"] is None and "down" in rows["bad"]["error"]
    assert QueryClient("http://h:1/").base_url == "http://h:1"


def test_technical_summaries_count_neighbours(graph):
    text = {r["id"]: r["summary"] for r in summaries.generate_summaries(*graph, "technical").collect()}
    counts = {r["id"]: len(r["neighbors"]) for r in summaries.node_context(*graph).collect()}
    assert any(counts.values()) and all((f"Dependencies: {n} |" in text[i] + " |") == (n > 0) for i, n in counts.items())


@pytest.mark.parametrize("fraction", [0.01, 0.2, 0.5, 1.0, 1.5])
def test_exact_split_takes_the_lowest_hashes(spark, fraction):
    import hashlib
    import math

    df = spark.range(700).repartition(5)
    got = {r["id"] for r in instruct.exact_split(df, "id", fraction).filter("split = 'validation'").collect()}
    order = sorted(range(700), key=lambda i: (hashlib.sha256(f"42:{i}".encode()).hexdigest(), i))
    assert got == set(order[: min(700, math.ceil(700 * fraction))])
    assert instruct.exact_split(df.limit(0), "id", fraction).count() == 0


def test_shuffled_batches_do_not_depend_on_partitions(spark):
    df = spark.range(30)
    assert [list(map(tuple, b)) for b in instruct.batches(df.repartition(7), 8, True)] == [list(map(tuple, b)) for b in instruct.batches(df.coalesce(1), 8, True)]


def test_report_has_issues_and_distribution(spark):
    rows = [("a", "howto", "p", "word " * 60, ["n"], "{}", 0), ("b", "howto", "P ", "TODO", ["x"], "{}", 1), ("b", "odd", "q", "word " * 60, [], "{}", 2)]
    examples = spark.createDataFrame(rows, "id string, type string, prompt string, response string, refs array<string>, metadata string, pos int")
    got = validate.report(examples, spark.createDataFrame([("n",)], "id string"), 50, 500, "pos")
    assert (got["total_examples"], got["valid_examples"], got["invalid_refs"], got["duplicates"], got["is_valid"]) == (3, 1, 1, 2, False)
    assert got["type_distribution"] == {"howto": 2, "odd": 1}
    assert got["issues"] == ["Duplicate ID: b", "Duplicate prompt: b", "Example 1 (b): Contains placeholder: TODO", "Example 1 (b): Response too short: 1 tokens (min: 50)", "Example 2 (b): Invalid type: odd", "Example 2 (b): refs list is empty", "Invalid node reference: b: x"]
    many = examples.filter("pos = 1").withColumn("refs", F.array([F.lit(f"x{i:02}") for i in range(30)]))
    assert validate.dataset_issues(many, spark.createDataFrame([("n",)], "id string"), order="pos").filter("kind = 'reference'").count() == 10
