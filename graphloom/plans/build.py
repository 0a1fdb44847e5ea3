"""The stages from a repository to instruction data, and an incremental variant."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import DatasetConfig, ExtractorConfig
from graphloom.operators import qa, validate
from graphloom.operators.classify import classify
from graphloom.operators.extract import extract_symbols, extraction_errors, to_graph
from graphloom.operators.graph import add_nodes
from graphloom.operators.instruct import to_instruction
from graphloom.operators.summaries import generate_summaries
from graphloom.sources.repo import list_files, read_contents
from graphloom.sources.store import GraphStore, write_instructions


def build_graph(spark: SparkSession, root: str, config: ExtractorConfig, mode: str = "overwrite") -> GraphStore:
    """Extract a repository into a new version of the store. append keeps nodes that are no longer found.

    Files that cannot be read or parsed are in store.errors(), and the rest goes on.

    Past the time limit the job group is cancelled and TimeoutError raised.
    """
    store, group = GraphStore(spark, config.out_graph), "graphloom-extract"
    late = threading.Event()
    timer = threading.Timer(config.processing_timeout_seconds, lambda: (late.set(), spark.sparkContext.cancelJobGroup(group)))
    spark.sparkContext.setJobGroup(group, "extract", interruptOnCancel=True)
    timer.start()
    try:
        symbols = store.stage("symbols", extract_symbols(read_contents(spark, list_files(spark, root, config))))  # parsed once, read by nodes, edges and errors
        nodes, edges = to_graph(symbols)
        if mode == "append":
            old = store.snapshot()
            all_nodes, left = add_nodes(old.nodes(True), old.edges(True), nodes.filter("type <> 'external'"))
            extra = nodes.filter("type = 'external'").join(all_nodes, "id", "left_anti")
            key = ["source_id", "target_id", "relationship"]
            nodes = all_nodes.unionByName(extra, allowMissingColumns=True)
            edges = left.join(edges, key, "left_anti").unionByName(edges, allowMissingColumns=True)
        store.write(nodes, edges, extraction_errors(symbols))
        store.expire()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"Extraction took more than {config.processing_timeout_seconds} s") from None
        raise
    finally:
        timer.cancel()
        store.drop("symbols")
    return store


def build_brain(store: GraphStore, style: str = "concise", existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Classified nodes and new summaries."""
    nodes = classify(store.nodes())
    return nodes, generate_summaries(nodes, store.edges(), style, existing)


def build_dataset(nodes: DataFrame, edges: DataFrame, summaries: DataFrame, config: DatasetConfig) -> bool:
    """Examples, checks, and the file if no example is invalid."""
    examples = qa.generate_all(nodes, edges, summaries, config.qa_categories, config.negatives_per_example).cache()
    try:
        report = validate.dataset_report(examples, nodes.select("id"), config.min_response_tokens, config.max_response_tokens)
        if not validate.gate(report):
            return False
        write_instructions(to_instruction(qa.shuffled(examples)), config.out_file)
        return True
    finally:
        examples.unpersist()


def percentages(examples: DataFrame) -> DataFrame:
    """type, count, percentage text with one digit."""
    counts = validate.type_distribution(examples)
    total = counts.agg(F.sum("count").alias("n"))
    return counts.join(F.broadcast(total)).select("type", "count", F.format_string("%.1f", F.lit(100.0) * F.col("count") / F.col("n")).alias("percentage")).orderBy("type")
