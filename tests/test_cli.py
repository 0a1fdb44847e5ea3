"""The command line from a repository to answers, and the word vectors that it searches."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import pytest

from graphloom import cli
from graphloom.functions.scalar import hash_number
from graphloom.operators import encoders, vectors
from graphloom.sources.store import GraphStore

TEXTS = [("a", "Parse the file, parse it again"), ("b", "the file is closed"), ("c", ""), ("d", None), ("e", "é --"), ("f", "Sort NUMBERS 42 times")]


def test_weights_against_plain_python(spark):
    df = spark.createDataFrame(TEXTS, "id string, summary string")
    words = sorted({w for _, t in TEXTS if t for w in re.findall("[0-9a-z]+", t.lower())})
    dim = {r["word"]: r["d"] for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", (hash_number("word", "dim") % 16).alias("d")).collect()}
    counts = {i: Counter(dim[w] for w in re.findall("[0-9a-z]+", (t or "").lower())) for i, t in TEXTS}
    idf = {k: math.log(7 / (sum(k in c for c in counts.values()) + 1)) + 1 for k in range(16)}
    got = {r["id"]: r["embedding"] for r in encoders.embed(df, encoders.fit(df, 16), 16).collect()}
    for i, c in counts.items():
        raw = [c[k] * idf[k] for k in range(16)]
        norm = math.sqrt(sum(x * x for x in raw)) or 1
        assert got[i] == pytest.approx([x / norm for x in raw], abs=1e-6)
    assert encoders.embed(df.limit(0), encoders.fit(df, 16), 16).count() == 0
    table = encoders.embed(df, encoders.fit(df))
    best = vectors.cosine_topk(table, encoders.encode_query(spark, "parse file", encoders.fit(df)), 2).collect()
    assert [r["id"] for r in best] == ["a", "b"]


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def parse_numbers(x):\n    return read_file(x)\n\n\nclass BadInputError(Exception):\n    pass\n\n\ndef main():\n    parse_numbers(1)\n")
    where = ["--graph", str(tmp_path / "g"), "--summaries", str(tmp_path / "s")]
    run = lambda *args: (cli.main([args[0], *where, *args[1:]]), capsys.readouterr().out)
    assert run("extract", "--repo", str(src))[0] == 0
    code, out = run("inspect", "--json")
    assert code == 0 and json.loads(out)["valid"] and json.loads(out)["total_nodes"] >= 5
    assert run("brain")[0] == 0
    (tmp_path / "s/broken.json").write_text("{cut\n")
    first, again = (json.loads(run("embed")[1]) for _ in range(2))
    assert first["new"] and not again["new"] and again["version"] == first["version"] and again["rejected_lines"] == 1
    assert GraphStore(spark, str(tmp_path / "g")).summaries().filter("embedding IS NULL").count() == 0
    assert "parse_numbers" in run("search", "parse numbers", "--top", "1")[1]
    config = tmp_path / "d.yaml"
    config.write_text(f"qa_categories: {{discovery: 2, explain: 2}}\nmin_response_tokens: 10\nout_file: {tmp_path}/data\n")
    assert run("dataset", "--config", str(config))[0] == 0
    code, out = run("validate", str(tmp_path / "data"), "--json")
    assert json.loads(out)["total_examples"] > 0 and code in (0, 1)
    (tmp_path / "q.txt").write_text("What is parsed?\n\nWho calls?\n")
    assert run("ask", str(tmp_path / "q.txt"), "--url", "http://127.0.0.1:9", "--out", str(tmp_path / "answers"))[0] == 0
    rows = spark.read.json(str(tmp_path / "answers")).collect()  # no server there: a record with an error each
    assert sorted(r["question"] for r in rows) == ["What is parsed?", "Who calls?"] and all(r["error"] for r in rows)
