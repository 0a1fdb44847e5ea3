from __future__ import annotations

import os

import pytest

from graphloom.config import BrainConfig, DatasetConfig, ExtractorConfig, load_config, save_config
from graphloom.functions import scalar
from graphloom.operators.extract import extract_file, make_id
from graphloom.operators.graph import integrity_report
from graphloom.plans import build
from graphloom.sources.repo import list_files, read_contents

PYTHON = b"import os\nfrom math import sqrt\n\n\ndef add(a, b):\n    return sqrt(a) + helper(b)\n\n\nclass Calc:\n    def run(self):\n        return self.go()\n\n\nhelper(1)\n"
JAVA = b"import java.util.List;\npublic class Calc { Calc() {} int add(int a) { return f(a); } }\n"


def of(rows, **kw):
    return [r for r in rows if all(r[k] == v for k, v in kw.items())]


def test_python_symbols():
    rows = extract_file("/r/a.py", "python", PYTHON)
    assert [r["name"] for r in of(rows, type="function")] == ["add", "run"]
    assert [r["name"] for r in of(rows, type="class")] == ["Calc"]
    assert {r["target_id"] for r in of(rows, relationship="imports")} == {make_id("import:import os"), make_id("import:from math import sqrt")}
    assert {r["target_id"] for r in of(rows, relationship="calls")} == {make_id("call:" + n) for n in ("sqrt", "helper", "go")}
    assert len(of(rows, relationship="defined_in")) == 3


def test_broken_python_and_other_languages():
    assert [r["name"] for r in of(extract_file("/a.py", "python", b"def f(:\n  g(1)\ndef h():\n  f(2)\n"), type="function")] == ["f", "h"]
    java = extract_file("/A.java", "java", JAVA)
    assert [r["type"] for r in of(java, kind="node")] == ["file", "class"] and not of(java, relationship="calls") and of(java, relationship="imports")
    ts = extract_file("/a.ts", "typescript", b"import {x} from 'y';\nfunction go(a) { return x(a); }\nclass K {}\n")
    assert [r["name"] for r in of(ts, kind="node")] == ["a.ts", "K", "go"] and len(of(ts, relationship="calls")) == 1
    cpp = extract_file("/a.cpp", "cpp", b"#include <a>\nint add(int a) { return f(a); }\nclass Q { };\n")
    assert {r["name"] for r in of(cpp, kind="node")} == {"a.cpp", "add", "Q"} and not of(cpp, relationship="imports")
    assert len(extract_file("/a.go", "go", b"func main() {}")) == 1
    empty = extract_file("/e.py", "python", b"")
    assert len(empty) == 1 and empty[0]["properties"] == '{"lines": 1}'


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "lib").mkdir(parents=True)
    (root / "test").mkdir()
    (root / "main.py").write_bytes(PYTHON)
    (root / "lib/helper.py").write_text("def f():\n    return 1\n")
    (root / "test/test_main.py").write_text("x = 1\n")
    (root / "Script.java").write_bytes(JAVA)
    (root / "large.py").write_text("#" * (1024 * 1024 + 1))
    outside = tmp_path / "outside.py"
    outside.write_text("def o(): pass\n")
    os.symlink(outside, root / "link.py")
    os.symlink(root / "nowhere.py", root / "broken.py")
    return root


def test_build_graph(spark, repo, tmp_path, monkeypatch):
    config = ExtractorConfig(languages=["python", "java"], exclude=["**/test/**"], out_graph=str(tmp_path / "g"), max_file_size_mb=1)
    assert {r["rel"] for r in list_files(spark, str(repo), config).collect()} == {"main.py", "lib/helper.py", "Script.java"}
    monkeypatch.chdir(repo)
    store = build.build_graph(spark, ".", config)
    report = integrity_report(store.nodes(), store.edges()).first()
    assert report["valid"], report["issues"]
    n = store.nodes().count()
    assert n >= 8 and store.nodes().filter("type = 'external'").count() >= 4
    build.build_graph(spark, ".", config, mode="append")
    assert store.nodes().count() == n
    nodes, summaries = build.build_brain(store)
    assert summaries.count() == n
    counts = DatasetConfig(qa_categories={"discovery": 5, "explain": 5}, out_file=str(tmp_path / "d"), min_response_tokens=10)
    assert isinstance(build.build_dataset(nodes, store.edges(), summaries, counts), bool)


def test_limits(spark, repo):
    with pytest.raises(ValueError, match="files"):
        list_files(spark, str(repo), ExtractorConfig(languages=["python"], max_total_files=1))
    with pytest.raises(ValueError, match="directory"):
        list_files(spark, str(repo / "none"), ExtractorConfig())


def test_languages(spark):
    names = ["a.py", "A.PY", "a.java", "a.ts", "a.tsx", "a.js", "a.cpp", "a.h", "a.c", "a.rs", "a.go", "a.txt", "Makefile"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    want = ["python", "python", "java", "typescript", "typescript", "javascript", "cpp", "cpp", "c", "rust", "go", None, None]
    assert [r[0] for r in df.select(scalar.language_of("p")).collect()] == want


def test_config(tmp_path):
    save_config(BrainConfig(summary_style="detailed"), tmp_path / "b.yaml")
    (tmp_path / "b.yaml").write_text((tmp_path / "b.yaml").read_text() + "unknown: 1\n")
    assert load_config(tmp_path / "b.yaml", BrainConfig).summary_style == "detailed"
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "no.yaml", BrainConfig)
    for make in (lambda: ExtractorConfig(languages=["cobol"]), lambda: DatasetConfig(qa_categories={"x": 1}), lambda: BrainConfig(node_types=["x"]), lambda: DatasetConfig(negatives_per_example=6)):
        with pytest.raises(ValueError):
            make()


def test_stream_adds_each_summary_once(spark, tmp_path):
    from graphloom.schema import EDGE_SCHEMA, NODE_SCHEMA
    from graphloom.sources.store import read_summaries
    from graphloom.streaming.incremental import summarise_stream

    edges = spark.createDataFrame([], EDGE_SCHEMA)
    for i in range(2):
        spark.createDataFrame([("n1", "file", "a", "/a", "python", "{}"), (f"x{i}", "class", "B", "/b", None, "{}")], NODE_SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        summarise_stream(spark, str(tmp_path / "in"), edges, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert read_summaries(spark, str(tmp_path / "out")).count() == 3


def test_names_with_pattern_characters_and_broken_files(spark, tmp_path):
    from graphloom.operators.extract import extract_file, extraction_errors, extract_symbols
    from graphloom.plans.build import build_graph

    src = tmp_path / "re[p]o{1}"
    (src / "pages").mkdir(parents=True)
    for name in ("pages/[id].ts", "pages/a*b.ts", "pages/{x}?.ts", "__init__.ts", "pages/i.ts"):
        (src / name).write_text("export function named() { return 1 }\n")
    store = build_graph(spark, str(src), ExtractorConfig(languages=["typescript"], out_graph=str(tmp_path / "graph")))
    assert sorted(r["name"] for r in store.nodes().filter("type = 'file'").collect()) == ["[id].ts", "__init__.ts", "a*b.ts", "i.ts", "{x}?.ts"]
    assert store.errors().count() == 0 and not (tmp_path / "graph" / "symbols").exists()
    assert extract_file("/x.py", "python", None)[0]["kind"] == "error"
    files = spark.createDataFrame([("/x.py", "python", None), ("/y.py", "python", b"def f(): pass\n")], "path string, lang string, content binary")
    assert [tuple(r) for r in extraction_errors(extract_symbols(files)).collect()] == [("/x.py", "OSError: the file could not be read")]


# Sources and what they hold: name, kind, first and last line; calls as caller > target at line; imports.
GRAMMAR = {
    "cpp": (
        b"#include <a>\nnamespace n {\nstatic const std::vector<int>& add(int a, int (*f)(int)) const noexcept {\n  if (a) { return f(a); } // g(\n  return x.go(\"}(\");\n}\nclass Q : public B {\n  int in() { return 1; }\n};\nint Q::out() { return 2; }\nenum class E { A };\n}\nint main() { return add(1); }\n",
        [("Q", "class", 7, 9), ("add", "function", 3, 6), ("main", "function", 13, 13)], [("add", "f", 4), ("add", "go", 5), ("main", "add", 13)], [],
    ),
    "java": (
        b"package a;\nimport java.util.List;\nimport static a.B.*;\n/* class No {} */ public final class Calc<T> extends X {\n  int add(int a) { String s = \"class Bad {\"; return f(Calc.class); }\n  class Inner {\n  }\n}\n",
        [("Calc", "class", 4, 8), ("Inner", "class", 6, 7)], [], ["import java.util.List;", "import static a.B.*;"],
    ),
    "typescript": (
        b"import {x} from 'y';\nimport 'z';\nexport default async function go<T extends {a: 1}>(a = (1 + 2)): Promise<void> {\n  await x(a);\n  const q = function inner() { y(); };\n  function deep() { z(`{${a}`); }\n  deep();\n}\nconst f = (a) => b(a);\nabstract class K<T> extends L { m() { n() } }\n",
        [("K", "class", 10, 10), ("go", "function", 3, 8), ("deep", "function", 6, 6)], [("go", "x", 4), ("go", "y", 5), ("deep", "z", 6), ("go", "deep", 7)], ["import {x} from 'y';", "import 'z';"],
    ),
}


@pytest.mark.parametrize("lang", sorted(GRAMMAR))
def test_symbols_of_a_table(lang):
    import json

    source, symbols, calls, imports = GRAMMAR[lang]
    rows = extract_file("/r/a", lang, source)
    assert rows[0]["type"] == "file" and rows[0]["error"] is None and json.loads(rows[0]["properties"]) == {"lines": source.count(b"\n") + 1}
    own = of(rows, kind="node")[1:]
    assert [(r["name"], r["type"], json.loads(r["properties"])["start_line"], json.loads(r["properties"])["end_line"]) for r in own] == symbols
    ids = {r["name"]: r["id"] for r in own}
    assert {(r["source_id"], r["target_id"]) for r in of(rows, relationship="defined_in")} == {(i, make_id("/r/a")) for i in ids.values()}
    assert [(r["source_id"], r["target_id"], json.loads(r["properties"])["call_line"]) for r in of(rows, relationship="calls")] == [(ids[a], make_id("call:" + b), n) for a, b, n in calls]
    assert [r["target_id"] for r in of(rows, relationship="imports")] == [make_id("import:" + i) for i in imports]


def test_ids_hold_path_line_kind_and_text():
    row = of(extract_file("/r/m.cpp", "cpp", GRAMMAR["cpp"][0]), name="main")[0]
    assert row["id"] == make_id("/r/m.cpp:13:function:int main() { return add(1); }")


def test_warnings_and_unknown_languages(spark):
    from graphloom.operators.extract import extract_symbols, extraction_errors, extraction_warnings
    from graphloom.operators.grammar import language

    with pytest.raises(ValueError, match="Unsupported language: cobol"):
        language("cobol")
    files = [("/a.py", "python", b"def f(:\n  g(1)\n"), ("/b.ts", "typescript", b"function f() { class A { }"), ("/c.go", "go", b"func main() {}"), ("/d.cob", "cobol", b""), ("/e.ts", "typescript", b"let a = 'x\n"), ("/f.java", "java", b"class A { }")]
    symbols = extract_symbols(spark.createDataFrame(files, "path string, lang string, content binary"))
    warned = {r["path"]: r["warning"] for r in extraction_warnings(symbols).collect()}
    assert warned == {"/a.py": "the file has parse errors", "/b.ts": "the file has parse errors: 1", "/c.go": "no patterns for go", "/e.ts": "the file has parse errors: 1"}
    assert [r["path"] for r in extraction_errors(symbols).collect()] == ["/d.cob"]
    assert symbols.filter("path = '/b.ts' AND kind = 'node'").count() == 3  # function and class are read all the same


def test_languages_can_be_added_as_data(spark):
    from graphloom.operators.extract import extract_symbols
    from graphloom.operators.grammar import TABLES, Language, dump_tables, load_tables

    assert load_tables(dump_tables(TABLES)) == TABLES
    own = load_tables('{"toy": {"name": "toy", "comments": [["--", "\\n"]], "strings": ["\'"], "symbols": [["function", "fun NAME () {}"], ["import", "use ... ;"]]}}')
    assert own["toy"] == Language("toy", comments=(("--", "\n"),), strings=("'",), symbols=(("function", "fun NAME () {}"), ("import", "use ... ;")))
    files = spark.createDataFrame([("/a.toy", "toy", b"use b;\nfun f() { g(1); -- h(\n}\n")], "path string, lang string, content binary")
    got = extract_symbols(files, own).collect()
    assert [(r["kind"], r["type"] or r["relationship"]) for r in got] == [("node", "file"), ("node", "function"), ("edge", "defined_in"), ("edge", "imports"), ("edge", "calls")]


def test_scopes_take_linear_time():
    import time

    source = "".join(f"function f{i}(a: number) {{ return g{i}(a); }}\n" for i in range(40_000)).encode()
    began = time.time()
    rows = extract_file("/a.ts", "typescript", source)
    assert len(of(rows, relationship="calls")) == 40_000 and time.time() - began < 10
    deep = b"".join(b"function f%d() { g(); " % i for i in range(3000)) + b"}" * 3000
    assert len(of(extract_file("/b.ts", "typescript", deep), relationship="calls")) == 3000


def test_python_ids_hold_the_text_of_the_definition_alone():
    row = of(extract_file("/r/a.py", "python", "x = 'é'\nif x:\n    def f(): return 'é'; y = 1\n\n    @deco\n    class K:\n        pass\n\n\nz = 2\n".encode()), kind="node")
    assert [r["id"] for r in row[1:]] == [make_id("/r/a.py:3:function:def f(): return 'é'; y = 1"), make_id("/r/a.py:6:class:class K:\n        pass")]


def mounted_through_viewfs(spark, name, at):
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{at}")
    return f"viewfs://{name}/in"


def test_a_repository_behind_a_file_system_that_only_the_engine_opens(spark, repo, tmp_path):
    (repo / "lib/__init__.py").write_text("def g(): return f()\n")
    (repo / "lib/space name[1].py").write_text("def h(): pass\n")
    for link in ("link.py", "broken.py"):
        (repo / link).unlink()
    root = mounted_through_viewfs(spark, "code", repo)
    config = ExtractorConfig(languages=["python", "java"], exclude=["**/test/**"], out_graph=str(tmp_path / "g"), max_file_size_mb=1)
    away, here = list_files(spark, root, config), list_files(spark, str(repo), config)
    assert sorted((r["rel"], r["length"], r["lang"]) for r in away.collect()) == sorted((r["rel"], r["length"], r["lang"]) for r in here.collect())
    contents = lambda files: sorted((r["rel"], bytes(r["content"])) for r in read_contents(spark, files).collect())
    assert contents(away) == contents(here) and len(contents(away)) == 5
    store = build.build_graph(spark, root, config)
    assert store.errors().count() == 0 and store.nodes().filter("type = 'file'").count() == 5
    with pytest.raises(ValueError, match="directory"):
        list_files(spark, root + "/none", config)


def test_listing_in_parallel_equals_a_walk(spark, tmp_path):
    from graphloom.sources.repo import TreeReader

    want = set()
    for i in range(120):
        at = tmp_path / "r" / f"d{i % 7}" / f"e{i % 5}" / f"f{i % 3}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"x{i}.py").write_text("pass\n")
        want.add(str((at / f"x{i}.py").relative_to(tmp_path / "r")))
    (tmp_path / "r/top.py").write_text("pass\n")
    os.symlink(tmp_path / "r/top.py", tmp_path / "r/again.py")
    os.symlink(tmp_path / "r/d0", tmp_path / "r/loop")
    reader = TreeReader(str(tmp_path / "r"), {".py"}, 20)
    assert len(reader.partitions()) >= 20
    got = [r[1] for p in reader.partitions() for r in reader.read(p)]
    assert sorted(got) == sorted([*want, "top.py", "again.py"])
    listed = list_files(spark, f"file:{tmp_path}/r", ExtractorConfig(languages=["python"])).collect()
    assert {r["rel"] for r in listed} == {*want, "again.py"}


def test_a_machine_without_the_mount_fails(spark):
    files = spark.createDataFrame([("/no/such/mount/a.py", "a.py", 1, "python")], "path string, rel string, length bigint, lang string")
    with pytest.raises(Exception, match="mounted on this machine"):
        read_contents(spark, files).collect()
    gone = spark.createDataFrame([("/tmp/gone-for-good.py", "a.py", 1, "python")], "path string, rel string, length bigint, lang string")
    assert read_contents(spark, gone).collect()[0]["content"] is None


def test_the_time_limit_ends_a_run_and_leaves_the_store(spark, repo, tmp_path, monkeypatch):
    import time

    config = ExtractorConfig(languages=["python"], out_graph=str(tmp_path / "g"))
    store = build.build_graph(spark, str(repo), config)
    version, n = store.version, store.nodes().count()

    def slow(session, files):
        def run(parts):
            for part in parts:
                time.sleep(40)
                yield part

        return files.withColumn("content", F.lit(b"")).repartition(1).mapInPandas(run, "path string, rel string, length bigint, lang string, content binary")

    from pyspark.sql import functions as F

    monkeypatch.setattr(build, "read_contents", slow)
    config.processing_timeout_seconds = 2  # less than a configuration may say
    began = time.time()
    with pytest.raises(TimeoutError, match="more than 2 s"):
        build.build_graph(spark, str(repo), config)
    assert time.time() - began < 30 and (store.version, store.nodes().count()) == (version, n)
