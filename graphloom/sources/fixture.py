"""A property graph over the driver's relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter + ":"), F.col(key).cast("string"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _node(df: DataFrame, nid: Column, kind: str, name: Column, path: Column | None, lang: str | None, props: Column | str) -> DataFrame:
    return df.select(
        nid.alias("id"),
        F.lit(kind).alias("type"),
        name.alias("name"),
        (path if path is not None else F.lit(None).cast("string")).alias("path"),
        F.lit(lang).cast("string").alias("lang"),
        (F.lit(props) if isinstance(props, str) else props).alias("properties"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    t = lambda name: table(spark, sf_dir, name)
    prefix = F.element_at(F.array(*map(F.lit, ["main_", "_", "test_", "run_", ""])), (c("p_partkey") % 5 + 1).cast("int"))
    parts = [
        _node(t("region"), _id("r", "r_regionkey"), "file", c("r_name"), _text("/", c("r_name")), "python", _text('{"lines": ', c("r_regionkey") + 10, "}")),
        _node(t("nation"), _id("n", "n_nationkey"), "class", c("n_name"), _text("/nation/", c("n_nationkey")), "java", _text('{"start_line": ', c("n_nationkey"), ', "end_line": ', c("n_nationkey") + 5, "}")),
        _node(t("customer"), _id("c", "c_custkey"), "function", c("c_name"), _text("/customer/", c("c_custkey") % 10), "python", _text('{"start_line": ', c("c_custkey"), "}")),
        _node(t("supplier"), _id("s", "s_suppkey"), "class", c("s_name"), None, None, "{}"),
        _node(t("part"), _id("p", "p_partkey"), "function", F.concat(prefix, c("p_name")), _text("/part/", c("p_brand")), "cpp", _text('{"start_line": ', c("p_size"), ', "end_line": ', c("p_size") + 3, ', "public": true, "doc": "', c("p_type"), ' part", "tags": [1]}')),
        _node(t("events").select("event_type").distinct(), _id("e", "event_type"), "class", c("event_type"), F.lit("/events"), "go", "{}"),
        _node(t("conversations").select("conv_id", "turn").distinct(), _text("t:", c("conv_id"), ":", c("turn")), "concept", _text("turn ", c("turn")), None, None, "{}"),
        _node(t("pages").select("page_id", "url"), _id("g", "page_id"), "file", c("url"), c("url"), None, "{}"),
    ]
    return reduce(DataFrame.unionByName, parts)


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of a part to a supplier; seq is total for each pair."""
    return table(spark, sf_dir, "lineitem").select(
        _id("p", "l_partkey").alias("source_id"),
        _id("s", "l_suppkey").alias("target_id"),
        F.lit("calls").alias("relationship"),
        F.lit(1.0).alias("weight"),
        _text('{"call_line": ', F.col("l_linenumber"), "}").alias("properties"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"),
    )


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of a user's consecutive event types, self-loops among them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_type", F.lead("event_type").over(w).alias("next"))
    return e.filter(F.col("next").isNotNull()).distinct()


def _edge(df: DataFrame, source: Column, target: Column, relationship: str) -> DataFrame:
    return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(relationship).alias("relationship"), F.lit(1.0).alias("weight"), F.lit("{}").alias("properties"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.graph import upsert_edges

    t = lambda name: table(spark, sf_dir, name)
    turn = F.col("turn")
    chain = t("conversations").select("conv_id", "turn").distinct()
    nxt = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")
    hit = t("events").filter("event_type = 'error'").select(F.col("user_id").alias("c_custkey")).distinct().join(t("customer").select("c_custkey"), "c_custkey", "left_semi")
    parts = [
        _edge(t("nation"), _id("n", "n_nationkey"), _id("r", "n_regionkey"), "defined_in"),
        _edge(t("customer"), _id("c", "c_custkey"), _id("n", "c_nationkey"), "defined_in"),
        _edge(t("supplier"), _id("s", "s_suppkey"), _id("n", "s_nationkey"), "defined_in"),
        upsert_edges(call_log(spark, sf_dir)).drop("seq"),
        _edge(event_pairs(spark, sf_dir), _id("e", "event_type"), _id("e", "next"), "calls"),
        _edge(hit, _id("c", "c_custkey"), F.lit("e:error"), "throws"),
        _edge(t("pages").select("page_id", href).distinct(), _id("g", "page_id"), _id("x", "href"), "imports"),
        _edge(chain.withColumn("next", nxt).filter("next = turn + 1"), _text("t:", F.col("conv_id"), ":", turn), _text("t:", F.col("conv_id"), ":", F.col("next")), "depends_on"),
    ]
    return reduce(DataFrame.unionByName, parts)


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as examples: short texts, repeated prompts, bad types and references occur."""
    d = table(spark, sf_dir, "documents")
    bad = F.col("doc_id") % 10 == 0
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.element_at(F.array(*map(F.lit, ["discovery", "explain", "howto", "diagnostics"])), (F.col("doc_id") % 4 + 1).cast("int"))).alias("type"),
        F.col("text").alias("prompt"),
        F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" [TODO]"))).otherwise(F.col("text")).alias("response"),
        F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(bad, F.concat(F.lit("z:"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("c:"), (F.col("doc_id") % 100).cast("string"))))).alias("refs"),
        F.lit("{}").alias("metadata"),
        F.col("doc_id").alias("pos"),
    )
