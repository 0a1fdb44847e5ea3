"""Store of a graph and its summaries in versions, and JSON files of summaries and examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.graph import GraphError, add_edges, add_nodes
from graphloom.schema import EDGE_SCHEMA, ERROR_SCHEMA, INSTRUCT_SCHEMA, NODE_SCHEMA, SUMMARY_SCHEMA
from graphloom.sources.snapshots import Folder, Snapshots

CREATED = T.StructField("created_at", T.TimestampType())
EDGE_KEY = ["source_id", "target_id", "relationship"]


class GraphStore:
    """Versions of nodes, edges, extraction errors and summaries.

    Nodes are partitioned by type and edges by relationship, so that their filters prune files;
    summaries are bucketed by id. Each row of the graph keeps the time at which it was
    written; a row that is replaced gets a new one. nodes() and edges() read the last
    version each time; what must fit together is read from one snapshot().
    """

    def __init__(self, spark: SparkSession, path: str, manifest: dict | None = None):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), Snapshots(spark, path)
        self.fixed = manifest

    def snapshot(self, version: int | None = None) -> GraphStore:
        """The store as of a version, by default the last; what others write is not seen."""
        return GraphStore(self.spark, self.path, self.tables.manifest(version))

    @property
    def version(self) -> int:
        return (self.fixed or self.tables.manifest())["version"]

    def _read(self, name: str, schema: T.StructType, times: bool = False) -> DataFrame:
        return self.tables.read(name, T.StructType([*schema.fields, CREATED]) if times else schema, self.fixed)

    # --- reading ---

    def nodes(self, times: bool = False) -> DataFrame:
        """Nodes; with created_at if times."""
        return self._read("nodes", NODE_SCHEMA, times)

    def edges(self, times: bool = False) -> DataFrame:
        return self._read("edges", EDGE_SCHEMA, times)

    def errors(self) -> DataFrame:
        """path, error of the files of the last extraction that gave no symbols."""
        return self._read("errors", ERROR_SCHEMA)

    def summaries(self) -> DataFrame:
        return self._read("summaries", SUMMARY_SCHEMA)

    # --- writing ---

    def write(self, nodes: DataFrame, edges: DataFrame, errors: DataFrame | None = None, at: str | None = None) -> int:
        """Replace the graph; the new version. Nothing is visible before all of it is written.

        Rows without created_at get the time of writing, or at. Keys that repeat raise
        GraphError.
        """
        base = self._base()
        entries = {"nodes": self._put("nodes", nodes, ["id"], "type", at), "edges": self._put("edges", edges, EDGE_KEY, "relationship", at)}
        if errors is not None:
            entries["errors"] = self.tables.write("errors", errors)
        return self.tables.commit(entries, base)["version"]

    def upsert(self, nodes: DataFrame, edges: DataFrame, at: str | None = None) -> int:
        """Replace or add nodes by id and edges by their keys; edges at replaced nodes go. Other rows keep their time."""
        now = self.snapshot()
        kept, left = add_nodes(now.nodes(True), now.edges(True), nodes)
        return self.write(kept, add_edges(kept, left, edges), at=at)

    def _put(self, name: str, df: DataFrame, key: list[str], part: str, at: str | None) -> dict:
        schema = NODE_SCHEMA if name == "nodes" else EDGE_SCHEMA
        time = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
        own = F.coalesce("created_at", time) if "created_at" in df.columns else time
        entry = self.tables.write(name, df.select(*schema.names, own.alias("created_at")), [part])
        if twice := self.tables.read_entry(entry, schema).groupBy(*key).count().filter("count > 1").head(1):
            raise GraphError(f"Repeated key in {name}: {', '.join(map(str, twice[0][:-1]))}")
        return entry

    def merge_summaries(self, rows: DataFrame, buckets: int = 64) -> int:
        """Add summaries, each in place of that of its id; the version, which stays if there are none.

        Only the buckets that rows fall into are written.
        """
        base = self._base()
        entry = base["tables"].get("summaries") or {"folders": {}, "key": ["id"], "buckets": buckets}
        new = self.tables.merge("summaries", rows.select(*SUMMARY_SCHEMA.names), entry)
        return base["version"] if new is entry else self.tables.commit({"summaries": new}, base)["version"]

    def embed_summaries(self, embed: Callable[[DataFrame], DataFrame]) -> int:
        """Give summaries without an embedding theirs, where embed (of such rows) finds one; the version as above."""
        made = embed(self.snapshot().summaries().filter(F.col("embedding").isNull()))
        return self.merge_summaries(made.filter(F.col("embedding").isNotNull()))

    def expire(self, keep: int = 2) -> int:
        return self.tables.expire(keep)

    def _base(self) -> dict:
        if self.fixed:
            raise GraphError("a snapshot is read only")
        return self.tables.manifest()

    # --- beside the versions ---

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Write df beside the graph and read it back."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete what was staged, or with an empty name the store."""
        Folder(self.spark, self.path).delete(name)


def write_summaries(summaries: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, many summaries a file."""
    summaries.write.mode(mode).json(path)


def split_rejects(spark: SparkSession, path: str, schema: T.StructType, required: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and rejects: file, line, reason of lines that do not parse or have no required field.

    The lines are read once a side and parsed without dropping any, so that rows and
    rejects together are as many as lines that are not blank.
    """
    bad = "_corrupt"
    whole = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), "value").filter(F.trim("value") != "")
    parsed = lines.withColumn("_row", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    reason = F.when(F.col("_row").isNull() | F.col(f"_row.{bad}").isNotNull(), "not an object of the schema").when(F.col(f"_row.{required}").isNull(), f"no {required}")
    parsed = parsed.withColumn("_reason", reason)
    rows = parsed.filter("_reason IS NULL").select(*[F.col("_row")[f].alias(f) for f in schema.names])
    return rows, parsed.filter("_reason IS NOT NULL").select(F.col("_file").alias("file"), F.col("value").alias("line"), F.col("_reason").alias("reason"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of a folder, an id once; lines that cannot be read are in rejected_summaries."""
    return split_rejects(spark, path, SUMMARY_SCHEMA, "id")[0].dropDuplicates(["id"])


def rejected_summaries(spark: SparkSession, path: str) -> DataFrame:
    """file, line, reason of the lines of a folder that give no summary."""
    return split_rejects(spark, path, SUMMARY_SCHEMA, "id")[1]


def rejected_instructions(spark: SparkSession, path: str) -> DataFrame:
    """file, line, reason of the lines that are no {messages, metadata} objects."""
    shape = T.StructType([INSTRUCT_SCHEMA["messages"]])
    return split_rejects(spark, path, shape, "messages")[1]


def write_instructions(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One {messages, metadata} object a line, metadata as an object."""
    line = F.concat(F.lit('{"messages":'), F.to_json("messages"), F.lit(',"metadata":'), F.coalesce("metadata", F.lit("{}")), F.lit("}"))
    rows.select(line.alias("value")).write.mode(mode).text(path)


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """messages and metadata (as JSON text) of instruction lines."""
    text = spark.read.text(path)
    parsed = F.from_json("value", INSTRUCT_SCHEMA).alias("x")
    return text.select(parsed, F.get_json_object("value", "$.metadata").alias("m")).select("x.messages", F.col("m").alias("metadata"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Example lines for the validator: {id, prompt, ...} or the {messages, metadata} shape."""
    from graphloom.operators.validate import parse_examples

    own = F.get_json_object("value", "$.messages").isNotNull()
    flat = F.to_json(
        F.struct(
            F.get_json_object("value", "$.metadata.id").alias("id"),
            F.get_json_object("value", "$.metadata.type").alias("type"),
            F.get_json_object("value", "$.messages[1].content").alias("prompt"),
            F.get_json_object("value", "$.messages[2].content").alias("response"),
            F.from_json(F.get_json_object("value", "$.metadata.refs"), "array<string>").alias("refs"),
        )
    )
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return parse_examples(lines.select(F.when(own, flat).otherwise(F.col("value")).alias("value")))
