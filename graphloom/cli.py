"""Command line: extract, brain, embed, search, dataset, validate, ask, inspect."""

from __future__ import annotations

import argparse
import json
import sys

from graphloom.config import BrainConfig, DatasetConfig, ExtractorConfig, load_config
from graphloom.operators import encoders, graph, inference, validate, vectors
from graphloom.plans import build
from graphloom.session import get_session
from graphloom.sources.store import GraphStore, read_examples, read_summaries, rejected_summaries, write_summaries


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("extract", "brain", "embed", "search", "dataset", "validate", "ask", "inspect"):
        p = sub.add_parser(name)
        p.add_argument("--config")
        p.add_argument("--graph", default="data/brain/graph")
        p.add_argument("--summaries", default="data/brain/summaries")
        if name == "extract":
            p.add_argument("--repo", default=".")
            p.add_argument("--mode", choices=["overwrite", "append"], default="overwrite")
        if name in ("inspect", "validate"):
            p.add_argument("--json", action="store_true")
        if name == "search":
            p.add_argument("text")
            p.add_argument("--top", type=int, default=5)
        if name == "validate":
            p.add_argument("data")
        if name == "ask":
            p.add_argument("questions", help="a text file, a question a line")
            p.add_argument("--url", default="http://localhost:8000")
            p.add_argument("--out", required=True)
    a = parser.parse_args(argv)
    spark = get_session()
    store = GraphStore(spark, a.graph)
    if a.command == "extract":
        config = load_config(a.config, ExtractorConfig) if a.config else ExtractorConfig(out_graph=a.graph)
        build.build_graph(spark, a.repo, config, a.mode)
    elif a.command == "brain":
        config = load_config(a.config, BrainConfig) if a.config else BrainConfig()
        _, summaries = build.build_brain(store, config.summary_style)
        write_summaries(summaries, a.summaries)
    elif a.command == "embed":
        version = store.merge_summaries(read_summaries(spark, a.summaries).join(store.summaries().select("id"), "id", "left_anti"))
        idf = encoders.fit(store.snapshot().summaries())
        done = store.embed_summaries(lambda rows: encoders.embed(rows, idf))
        print(json.dumps({"version": done, "new": done != version, "rejected_lines": rejected_summaries(spark, a.summaries).count()}))
    elif a.command == "search":
        held = store.snapshot().summaries()
        found = vectors.cosine_topk(held, encoders.encode_query(spark, a.text, encoders.fit(held)), a.top)
        for r in found.join(held.select("id", "name", "summary"), "id").orderBy("similarity", ascending=False).collect():
            print(f"{r['similarity']:.4f}  {r['name']}  {r['summary']}")
    elif a.command == "validate":
        out = validate.report(read_examples(spark, a.data), store.nodes().select("id"), order="pos")
        print(json.dumps(out, indent=2) if a.json else "\n".join(f"{k}: {v}" for k, v in out.items()))
        return 0 if out["is_valid"] else 1
    elif a.command == "ask":
        lines = spark.read.text(a.questions).filter("trim(value) <> ''").withColumnRenamed("value", "question")
        inference.ask(lines, lambda: inference.QueryClient(a.url)).write.mode("overwrite").json(a.out)
    elif a.command == "dataset":
        config = load_config(a.config, DatasetConfig) if a.config else DatasetConfig()
        nodes = build.classify(store.nodes())
        return 0 if build.build_dataset(nodes, store.edges(), read_summaries(spark, a.summaries), config) else 1
    else:
        out = graph.get_stats(store.nodes(), store.edges()) | graph.integrity_report(store.nodes(), store.edges()).first().asDict()
        print(json.dumps(out, indent=2) if a.json else "\n".join(f"{k}: {v}" for k, v in out.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
