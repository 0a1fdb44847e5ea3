"""Node summaries from graph context; templates are plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import text_or_none, token_estimate, word_count
from graphloom.operators.graph import first_neighbors

NEIGHBORS = 5


def node_context(nodes: DataFrame, edges: DataFrame | None, k: int = NEIGHBORS, only: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """Nodes with neighbors (at most k names), line and lines; only (a column id) narrows to some nodes.

    near (me, neighbors) takes the place of edges where neighbours are known. A node that has an end line without a start line gives no context and is dropped.
    """
    prop = lambda key: F.get_json_object("properties", "$." + key)
    near = (first_neighbors(nodes, edges, k, only) if near is None else near).withColumnRenamed("me", "id")
    own = nodes if only is None else nodes.join(only.select("id"), "id", "left_semi")
    return (
        own.join(near, "id", "left")
        .withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<string>")))
        .withColumn("line", F.try_to_number(prop("start_line"), F.lit("999999999")).cast("bigint"))
        .withColumn("_end", prop("end_line"))
        .filter(F.col("line").isNotNull() | F.col("_end").isNull())
        .withColumn("lines", F.concat(F.col("line").cast("string"), F.lit("-"), "_end"))
        .drop("_end")
    )


def concise(c: DataFrame | None = None) -> Column:
    name, kind = F.concat(F.lit("'"), "name", F.lit("'")), F.col("type")
    path = text_or_none("path")
    say = lambda role: F.concat(name, F.lit(f" is a {role} in "), path, F.lit("."))
    base = (
        F.when(kind == "module", say("module"))
        .when(kind == "function", say("function"))
        .when(kind == "class", say("class"))
        .when(kind == "capability", say("capability that callers can use"))
        .when(kind == "error", say("failure that callers must handle"))
        .when(kind == "recipe", say("worked recipe"))
        .when(kind == "concept", F.concat(name, F.lit(" is a "), kind, F.lit(" defined in "), path, F.lit(".")))
        .when(kind == "file", F.concat(name, F.lit(" is a source file written in "), text_or_none("lang"), F.lit(".")))
        .otherwise(F.concat(name, F.lit(" is a "), kind, F.lit(".")))
    )
    near = F.array_join(F.slice("neighbors", 1, 3), ", ")
    return F.concat(base, F.when(F.size("neighbors") > 0, F.concat(F.lit(" See also: "), near, F.lit("."))).otherwise(""))


def detailed() -> Column:
    doc = F.get_json_object("properties", "$.doc")
    return F.concat_ws(
        " ",
        concise(),
        F.when(F.col("lines").isNotNull(), F.concat(F.lit("It takes up lines "), "lines", F.lit("."))).when(
            F.col("line") != 0, F.concat(F.lit("It starts on line "), F.col("line").cast("string"), F.lit("."))
        ),
        F.when(F.col("lang") != "", F.concat(F.lit("Source language: "), "lang", F.lit("."))),
        F.when(F.size("neighbors") > 0, F.concat(F.lit("Neighbours: "), F.array_join("neighbors", ", "), F.lit("."))),
        F.when(doc != "", F.concat(F.lit("Its documentation begins: "), F.substring(doc, 1, 100), F.lit("..."))),
    )


def scalar_properties() -> Column:
    """'key: value' of each scalar property, in the order written; True and False as words."""
    kinds = F.from_json("properties", "map<string,variant>")
    texts = F.from_json("properties", "map<string,string>")
    entries = F.map_entries(kinds)
    kind_of = lambda e: F.schema_of_variant(e["value"])
    plain = F.filter(entries, lambda e: ~kind_of(e).rlike("^(OBJECT|ARRAY|VOID)"))
    text = lambda e: F.element_at(texts, e["key"])
    shown = lambda e: F.when(kind_of(e) == "BOOLEAN", F.initcap(text(e))).otherwise(text(e))
    return F.array_join(F.transform(plain, lambda e: F.concat(e["key"], F.lit(": "), shown(e))), " | ")


def technical() -> Column:
    """Fixed labels; of neighbours the number, at most NEIGHBORS."""
    extra = scalar_properties()
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Node ID: "), "name"),
        F.concat(F.lit("Type: "), "type"),
        F.concat(F.lit("Location: "), text_or_none("path")),
        F.when(F.col("lines").isNotNull(), F.concat(F.lit("Lines: "), "lines")),
        F.when(F.col("lang") != "", F.concat(F.lit("Language: "), "lang")),
        F.when(F.size("neighbors") > 0, F.concat(F.lit("Dependencies: "), F.size("neighbors").cast("string"))),
        F.when(extra != "", extra),
    )


def generate_summaries(nodes: DataFrame, edges: DataFrame | None, style: str = "concise", existing: DataFrame | None = None, only: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """Summary documents of nodes that existing has not, and of those in only (a column id) if given; any style but the first two is technical."""
    todo = node_context(nodes, edges, only=only, near=near)
    if existing is not None:
        todo = todo.join(existing.select("id"), "id", "left_anti")
    text = concise() if style == "concise" else detailed() if style == "detailed" else technical()
    context = F.struct(F.col("path").alias("file"), F.col("lang").alias("language"), "neighbors", "line", "lines")
    return todo.select("id", "type", "name", text.alias("summary"), context.alias("context"), F.lit(None).cast("array<float>").alias("embedding"))


def summary_stats(summaries: DataFrame, sample: int = 100) -> DataFrame:
    """Documents in all; average, least and most estimated tokens of the first by id."""
    total = summaries.agg(F.count("*").alias("total_summaries"))
    some = summaries.select("id", "summary").orderBy("id").limit(sample)
    tokens = token_estimate(F.col("summary"))
    stats = some.agg(
        F.avg(tokens).cast("bigint").alias("avg_tokens"), F.min(tokens).cast("bigint").alias("min_tokens"), F.max(tokens).cast("bigint").alias("max_tokens")
    )
    return total.join(stats)


__all__ = ["concise", "detailed", "generate_summaries", "node_context", "summary_stats", "technical", "word_count"]
