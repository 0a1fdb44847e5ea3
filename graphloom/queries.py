"""Registered queries: each operator applied to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import bpe, classify, encoders, graph, instruct, qa, scopes, summaries, traverse, validate, vectors
from graphloom.session import work_path
from graphloom.sources import fixture as fx
from graphloom.sources import store

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
EDGE = ["me", "id", "name", "relationship", "weight", "direction"]


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _near(s: SparkSession, d: str, direction: str, rel: str | None = None) -> DataFrame:
    out = graph.neighbors(fx.nodes(s, d), fx.edges(s, d), direction, rel)
    return out.select("me", "id", "name", F.col("edge.relationship").alias("relationship"), F.col("edge.weight").alias("weight"), F.col("edge.direction").alias("direction"))


@query
def graph_stats(s, d):
    return graph.graph_stats(fx.nodes(s, d), fx.edges(s, d))


@query
def node_type_distribution(s, d):
    return graph.distribution(classify.classify(fx.nodes(s, d)), "type")


@query
def edge_relationship_distribution(s, d):
    return graph.distribution(fx.edges(s, d), "relationship")


@query
def neighbors_outgoing(s, d):
    return _near(s, d, "outgoing")


@query
def neighbors_incoming(s, d):
    return _near(s, d, "incoming")


@query
def neighbors_both(s, d):
    return _near(s, d, "both")


@query
def neighbors_by_relationship(s, d):
    return _near(s, d, "both", "throws")


@query
def node_lookup(s, d):
    return graph.get_node(fx.nodes(s, d), "p:7")


@query
def out_degree_topk(s, d):
    nodes = classify.classify(fx.nodes(s, d))
    return graph.out_degree_topk(nodes, fx.edges(s, d), 25, ["capability", "concept", "class"]).select("id", "name", "type", "edge_count")


@query
def edge_upsert_last_write(s, d):
    return graph.upsert_edges(fx.call_log(s, d)).select("source_id", "target_id", "relationship", "weight", "properties")


def replay_logs(s, d):
    """Orders as node writes and line items as edge writes, in one order of time."""
    key = lambda letter, c: F.concat(F.lit(letter), (F.col(c) % 50).cast("string"))
    o, li = fx.table(s, d, "orders"), fx.table(s, d, "lineitem")
    seq = lambda c: F.col(c).cast("bigint")
    nodes = o.select(key("a", "o_custkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), (seq("o_orderkey") * 10).alias("seq"))
    edges = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("q"))
    edges = edges.select(key("a", "p").alias("source_id"), key("a", "q").alias("target_id"), F.lit("calls").alias("relationship"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1).cast("bigint").alias("seq"))
    return nodes, edges


@query
def node_upsert_cascade(s, d):
    nodes, edges = graph.replay(*replay_logs(s, d))
    e = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("edges"))
    return nodes.join(e, "id", "left").select("id", "name", F.coalesce("edges", F.lit(0)).cast("bigint").alias("edges"))


@query
def placeholder_nodes(s, d):
    return graph.placeholders(fx.nodes(s, d), fx.edges(s, d)).select("id", "type", "name", "properties")


@query
def orphan_edges(s, d):
    return graph.orphan_edges(fx.nodes(s, d), fx.edges(s, d)).select("source_id", "target_id", "relationship")


def broken(s, d):
    """Nodes and edges with values outside the vocabularies."""
    n = fx.nodes(s, d).withColumn("type", F.when(F.col("id") == "r:0", "planet").otherwise(F.col("type")))
    e = fx.edges(s, d).withColumn("relationship", F.when(F.col("source_id") == "n:3", "orbits").otherwise(F.col("relationship")))
    return n, e


@query
def invalid_vocab(s, d):
    return graph.invalid_vocabulary(*broken(s, d))


@query
def integrity_report(s, d):
    return graph.integrity_report(*broken(s, d))


def _paths(df: DataFrame) -> DataFrame:
    return df.select("start", F.array_join("path", ">").alias("path"), "depth")


def _all_paths(s, d, relationship: str, depth: int = 3) -> DataFrame:
    return _paths(traverse.traverse_paths(fx.nodes(s, d).select("id"), fx.edges(s, d), relationship, depth))


@query
def traverse_paths_defined_in(s, d):
    return _all_paths(s, d, "defined_in")


@query
def traverse_paths_chain(s, d):
    return _all_paths(s, d, "depends_on")


@query
def traverse_paths_cyclic(s, d):
    return _all_paths(s, d, "calls")


def deep_edges(s, d) -> DataFrame:
    """The calls with a chain of ten more in front of some, dead ends that circle, and a hub that all turns point at.

    Calls come from their log, repeated ones too: paths take each pair of ends once.
    """
    k = F.col("n_nationkey")
    step = lambda i: F.concat(F.lit("n:"), k.cast("string"), F.lit(f"/{i}"))
    n = fx.table(s, d, "nation")
    make = lambda df, a, b: df.select(a.alias("source_id"), b.alias("target_id"), F.lit("calls").alias("relationship"), F.lit(1.0).alias("weight"), F.lit("{}").alias("properties"))
    out = fx.call_log(s, d).drop("seq").unionByName(make(fx.event_pairs(s, d), F.concat(F.lit("e:"), "event_type"), F.concat(F.lit("e:"), "next")))
    for i in range(10):
        out = out.unionByName(make(n, step(i), step(i + 1)))
    out = out.unionByName(make(n.filter(k % 2 == 0), step(10), F.concat(F.lit("s:"), k.cast("string")))).unionByName(make(n.filter(k % 2 == 1), step(10), step(3)))
    return out.unionByName(make(n, step(5), F.lit("hub"))).unionByName(make(n.filter(k % 5 == 0), F.lit("hub"), step(8)))


@query
def traverse_paths_deep(s, d):
    """Depth 8 over calls: long chains, circles without an end, a hub."""
    return _paths(traverse.traverse_paths(None, deep_edges(s, d), "calls", 8))


@query
def semantic_types(s, d):
    return classify.classify(fx.nodes(s, d)).select("id", "type")


@query
def semantic_type_counts(s, d):
    return classify.classification_counts(classify.classify(fx.nodes(s, d)))


@query
def classification_stats(s, d):
    return classify.classification_stats(classify.classify(fx.nodes(s, d)))


@query
def stable_ids(s, d):
    return fx.nodes(s, d).select("id", scalar.stable_id(F.concat(F.lit("call:"), "name")).alias("stable"))


@query
def file_line_counts(s, d):
    return fx.table(s, d, "documents").select("doc_id", scalar.line_count(F.encode("text", "UTF-8")).alias("lines"))


@query
def language_of_path(s, d):
    exts = [".py", ".PY", ".java", ".ts", ".tsx", ".js", ".cpp", ".h", ".c", ".rs", ".go", ".txt", ""]
    p = fx.table(s, d, "part").select("p_partkey", F.concat(F.lit("/src/a.b/"), F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, exts)), (F.col("p_partkey") % len(exts) + 1).cast("int"))).alias("path"))
    return p.select("p_partkey", "path", scalar.language_of("path").alias("lang"))


@query
def exclude_filter(s, d):
    return fx.table(s, d, "pages").filter(~scalar.excluded("url", ["**/blog/**", "**/spam", "*.pyc"])).select("page_id", "url")


def _typed(s, d):
    return classify.classify(fx.nodes(s, d)), fx.edges(s, d)


@query
def node_context(s, d):
    return summaries.node_context(*_typed(s, d)).select("id", F.array_join("neighbors", "|").alias("neighbors"), "line", "lines")


def _summary(s, d, style):
    return summaries.generate_summaries(*_typed(s, d), style).select("id", "summary")


@query
def summary_concise(s, d):
    return _summary(s, d, "concise")


@query
def summary_detailed(s, d):
    return _summary(s, d, "detailed")


@query
def summary_technical(s, d):
    return _summary(s, d, "technical")


@query
def summary_incremental(s, d):
    have = fx.nodes(s, d).select("id").filter(~F.col("id").startswith("n:"))
    return summaries.generate_summaries(*_typed(s, d), "concise", have).select("id", "summary")


@query
def summary_stats(s, d):
    return summaries.summary_stats(summaries.generate_summaries(*_typed(s, d)))


def _qa(df: DataFrame) -> DataFrame:
    return df.select("id", "type", "prompt", "response", F.array_join("refs", ",").alias("refs"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _parts(s, d):
    """The classified graph, written once, and summaries of the nodes that the answers take."""
    n, e = _typed(s, d)
    n, e = written(n, "nodes"), written(e, "edges")
    ids = written(qa.chosen_ids(n, e, 50), "chosen")  # at most 1250
    return n, e, written(summaries.generate_summaries(n, e, "detailed", only=ids), "summaries")


@query
def qa_discovery(s, d):
    n, _, m = _parts(s, d)
    return _qa(qa.discovery(n, m, 50))


@query
def qa_explain(s, d):
    return _qa(qa.explain(*_parts(s, d), 50))


@query
def qa_howto(s, d):
    n, _, m = _parts(s, d)
    return _qa(qa.howto(n, m, 50))


@query
def qa_diagnostics(s, d):
    return _qa(qa.diagnostics(*_parts(s, d), 50))


@query
def qa_negatives(s, d):
    n, _, m = _parts(s, d)
    return _qa(qa.negatives(qa.discovery(n, m, 50), n, m, 2))


@query
def qa_metadata(s, d):
    n, _, m = _parts(s, d)
    x = qa.negatives(qa.discovery(n, m, 50), n, m, 2)
    get = lambda k: F.get_json_object("metadata", "$." + k).alias(k)
    return x.select("id", get("node_name"), get("node_type"), get("file"), get("is_negative"), get("original_id"))


@query
def qa_all(s, d):
    return _qa(qa.generate_all(*_parts(s, d), dict.fromkeys(["discovery", "explain", "howto", "diagnostics"], 50), 2, lambda df: written(df, "answers")))


@query
def token_estimate(s, d):
    return fx.table(s, d, "documents").select("doc_id", F.round(scalar.token_estimate("text"), 4).alias("tokens"))


@query
def example_issues(s, d):
    v = validate.validate_examples(fx.examples(s, d), 50, 500)
    return v.select("id", F.array_join("issues", "; ").alias("issues"))


@query
def ref_validation(s, d):
    return validate.reference_check(fx.examples(s, d), fx.nodes(s, d).select("id"))


@query
def duplicate_examples(s, d):
    return validate.duplicates(fx.examples(s, d), "pos")


@query
def type_distribution(s, d):
    return validate.type_distribution(fx.examples(s, d))


@query
def dataset_report(s, d):
    return validate.dataset_report(fx.examples(s, d), fx.nodes(s, d).select("id"), 50, 500, "pos")


@query
def dataset_issues(s, d):
    return validate.dataset_issues(fx.examples(s, d), fx.nodes(s, d).select("id"), 50, 500, "pos")


@query
def dataset_percentages(s, d):
    from graphloom.plans.build import percentages

    return percentages(fx.examples(s, d))


@query
def cosine_topk(s, d):
    v = fx.table(s, d, "embeddings")
    q = v.filter("vec_id = 0").select("embedding").first()[0]  # the one query vector
    return vectors.cosine_topk(v, q, 20, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query
def cosine_null_safe(s, d):
    v = fx.table(s, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: x * F.lit(0).cast("float"))).otherwise(F.col("embedding")).alias("e"))
    return v.select("vec_id", F.round(scalar.cosine("e", F.transform("e", lambda x: x + F.lit(1).cast("float"))), 6).alias("similarity"))


@query
def chatml_format(s, d):
    c = fx.table(s, d, "conversations")
    m = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    return m.select("conv_id", instruct.chatml(F.col("messages")).alias("chat"))


@query
def instruction_messages(s, d):
    i = instruct.to_instruction(fx.examples(s, d))
    return i.select(
        F.get_json_object("metadata", "$.id").alias("id"), F.get_json_object("metadata", "$.type").alias("type"), F.get_json_object("metadata", "$.refs[0]").alias("ref"),
        F.col("messages")[0]["content"].alias("system"), F.col("messages")[1]["content"].alias("prompt"), F.col("messages")[2]["content"].alias("response"),
    )


@query
def exact_split(s, d):
    return instruct.exact_split(fx.table(s, d, "documents").select("doc_id"), "doc_id", 0.2)


@query
def repo_totals(s, d):
    return fx.table(s, d, "documents").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _rows_of_tokens(s, d, ranks, pad: int) -> DataFrame:
    out = instruct.tokenize(fx.table(s, d, "conversations"), "text", bpe.loader(s, ranks), 64, pad)
    return out.select(F.array_join("input_ids", ",").alias("ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"))


@query
def tokenized_rows(s, d):
    """Fixed-length rows by byte-pair encoding with a public vocabulary."""
    return _rows_of_tokens(s, d, bpe.read_ranks(s, VOCABULARY), 0)


@query
def byte_token_rows(s, d):
    """The same rows with the vocabulary of single bytes, which SQL can state."""
    return _rows_of_tokens(s, d, {bytes([i]): i for i in range(256)}, 256)


@query
def embedded_summaries(s, d):
    """Summaries with vectors of weighted words."""
    made = summaries.generate_summaries(*_typed(s, d))
    out = encoders.embed(made, encoders.fit(made))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return out.select("id", F.size("embedding").alias("dims"), F.round(squares, 4).alias("length"))


@query
def summary_vectors(s, d):
    """The weight of every dimension that a summary has."""
    made = written(summaries.generate_summaries(*_typed(s, d)).select("id", "summary"), "made")
    each = encoders.weights(made, encoders.fit(made)).select("id", F.explode("entries").alias("e"))
    return each.select("id", "e.dim", F.round("e.w", 6).alias("weight"))


@query
def extracted_symbols(s, d):
    """Symbols of source files made from the part table."""
    p = fx.table(s, d, "part")
    body = F.concat(F.lit("import os\n\n\ndef "), F.regexp_replace("p_name", r"\W+", "_"), F.lit("_f(x):\n    return g"), F.col("p_partkey").cast("string"), F.lit("(x)\n"))
    files = p.select(F.concat(F.lit("/src/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("lang"), F.encode(body, "UTF-8").alias("content"))
    from graphloom.operators.extract import extract_symbols, to_graph

    nodes, edges = to_graph(extract_symbols(files))
    a = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.concat(F.lit("node "), "type").alias("what"), "n")
    return a.unionByName(edges.groupBy("relationship").agg(F.count("*").alias("n")).select(F.concat(F.lit("edge "), "relationship").alias("what"), "n"))


# --- the store -----------------------------------------------------------


def stored(s, d) -> store.GraphStore:
    """The fixture's graph, without edges of which an end is missing, as version 1 of a store of its own."""
    n, e, at = fx.nodes(s, d), fx.edges(s, d), store.GraphStore(s, work_path(s, "store"))
    ids = n.select(F.col("id").alias("_n"))
    for end in ("source_id", "target_id"):
        e = e.join(ids, F.col(end) == F.col("_n"), "left_semi")
    at.write(n, e, at="2020-01-01 00:00:00")
    return at


@query
def store_round_trip(s, d):
    """Both versions of a store in which nations were written again: their edges go with them."""
    at = stored(s, d)
    again = fx.nodes(s, d).filter("id LIKE 'n:%'").withColumn("name", F.lower("name"))
    at.upsert(again, at.edges().limit(0), at="2021-01-01 00:00:00")
    out = None
    for version in (1, 2):
        then = at.snapshot(version)
        edges = then.edges().select("relationship", F.col("source_id").alias("id")).unionByName(then.edges().select("relationship", F.col("target_id").alias("id"))).groupBy("id").agg(F.count("*").alias("ends"))
        rows = then.nodes(True).join(edges, "id", "left").select(F.lit(version).alias("version"), "id", "type", "name", F.year("created_at").alias("written"), F.coalesce("ends", F.lit(0)).cast("bigint").alias("ends"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def summary_merge(s, d):
    """A keyed store of summaries: made, some made again, embedded in two steps; the second finds nothing to do."""
    at = store.GraphStore(s, work_path(s, "summaries"))
    made = summaries.generate_summaries(*_typed(s, d))
    at.merge_summaries(made.filter("id NOT LIKE 't:%'"), 16)
    at.merge_summaries(made.filter("id LIKE 'n:%' OR id LIKE 't:%'").withColumn("summary", F.upper("summary")))
    embed = lambda rows: vectors.embed_summaries(rows.filter("id LIKE 'c:%' OR id LIKE 's:%'"), vectors.hashing_encoder(16))
    version = at.embed_summaries(embed)
    assert at.embed_summaries(embed) == version  # nothing new, nothing written
    return at.summaries().select("id", "summary", F.coalesce(F.size("embedding"), F.lit(0)).alias("dims"))


@query
def summary_rejects(s, d):
    """Summary lines made from documents, some cut off, some without an id: what is read, and what is refused."""
    doc = fx.table(s, d, "documents").select("doc_id", F.to_json(F.struct(F.when(F.col("doc_id") % 5 != 1, F.concat(F.lit("d:"), F.col("doc_id").cast("string"))).alias("id"), F.col("text").alias("summary"))).alias("line"))
    path = work_path(s, "lines")
    doc.select(F.when(F.col("doc_id") % 7 == 0, F.expr("substring(line, 1, length(line) - 2)")).otherwise(F.col("line")).alias("value")).write.text(path)
    kept = store.read_summaries(s, path).select("id", F.lit("kept").alias("outcome"), F.octet_length("summary").alias("bytes"))
    lost = store.rejected_summaries(s, path).select(F.lit(None).cast("string").alias("id"), F.col("reason").alias("outcome"), F.octet_length("line").alias("bytes"))
    return kept.unionByName(lost)


# --- scopes --------------------------------------------------------------


@query
def enclosing_function(s, d):
    """Calls (line items) in spans (orders) of a hundred files that nest, cross, and stand apart."""
    o, li = fx.table(s, d, "orders"), fx.table(s, d, "lineitem")
    begin = (F.col("o_orderkey") * 13) % 5000
    spans = o.select((F.col("o_custkey") % 100).alias("file"), begin.alias("first"), (begin + F.pow(F.lit(3), F.col("o_orderkey") % 8)).cast("bigint").alias("last"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("id"))
    calls = li.select((F.col("l_partkey") % 101).alias("file"), (F.col("l_orderkey") * 7 % 7500).alias("place"), "l_orderkey", "l_linenumber", "l_suppkey")
    return scopes.enclosing(calls, spans, ["file"])


# --- symbols -------------------------------------------------------------

# Sources in four languages; {k} is the part's key.
SOURCES = {
    "python": "import os\n\n\ndef f{k}(x):\n    return g{k}(x)\n",
    "java": "import java.util.L{k};\n// class No{k} {\nclass C{k} {\n  int a;\n}\n",
    "typescript": "import x from 'm{k}';\nfunction f{k}(a) {\n  /* no( */ return g{k}(a);\n}\n",
    "cpp": "#include <a>\nint f{k}(int a) {\n  return g{k}(a);\n}\nclass Q{k} {\n};\n",
}


@query
def symbol_details(s, d):
    """Every node and edge, with its id, of sources in four languages, one a part."""
    from graphloom.operators.extract import extract_symbols

    key, langs = F.col("p_partkey").cast("string"), list(SOURCES)
    pick = lambda of: F.element_at(F.array(*of), (F.col("p_partkey") % 4 + 1).cast("int"))
    body = pick([F.replace(F.lit(SOURCES[n]), F.lit("{k}"), key) for n in langs])
    files = fx.table(s, d, "part").select(F.concat(F.lit("/src/"), key).alias("path"), pick(map(F.lit, langs)).alias("lang"), F.encode(body, "UTF-8").alias("content"))
    return extract_symbols(files).select("kind", "id", "type", "name", "path", "lang", "properties", "source_id", "target_id", "relationship", "error")
