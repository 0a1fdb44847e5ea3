"""Checks of question-answer examples: fields, lengths, placeholders, references, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalar import strip, token_estimate
from graphloom.schema import QA_CATEGORIES

# Required keys and the marks of unfinished text.
REQUIRED = ["id", "type", "prompt", "response", "refs"]
PLACEHOLDERS = ["{}", "[]", "[TODO]", "TODO", "FIXME", "XXX", "[...]"]


def parse_examples(lines: DataFrame, column: str = "value") -> DataFrame:
    """pos, raw, keys and typed fields from one JSON text a row; keys tells a missing key from a null."""
    s = "id string, type string, prompt string, response string, refs array<string>, metadata string"
    parsed = F.from_json(column, s)
    return lines.select(
        (F.col("pos") if "pos" in lines.columns else F.monotonically_increasing_id().alias("pos")),
        F.col(column).alias("raw"),
        F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")).alias("keys"),
        F.get_json_object(column, "$.refs").alias("raw_refs"),
        parsed.alias("x"),
    ).select("pos", "raw", "keys", "raw_refs", "x.*")


def issues_of(min_tokens: float = 50, max_tokens: float = 500, tokens: Column | None = None) -> Column:
    """Array of issue texts (fixed values) of one parsed example; a missing key ends the checks."""
    has = lambda k: F.array_contains("keys", k)
    missing = F.filter(F.array(*[F.when(~has(k), f"Missing required field: {k}") for k in REQUIRED]), lambda m: m.isNotNull())
    tokens = token_estimate(F.coalesce("response", F.lit(""))) if tokens is None else tokens
    shown = F.bround(tokens, 0).cast("bigint").cast("string")
    empty = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    checks = [
        F.when(empty("prompt"), "Empty prompt"),
        F.when(empty("response"), "Empty response"),
        F.when(tokens < min_tokens, F.concat(F.lit("Response too short: "), shown, F.lit(f" tokens (min: {min_tokens})"))),
        F.when(tokens > max_tokens, F.concat(F.lit("Response too long: "), shown, F.lit(f" tokens (max: {max_tokens})"))),
        *[F.when(F.contains("response", F.lit(p)), f"Contains placeholder: {p}") for p in PLACEHOLDERS],
        F.when(F.col("refs").isNull(), "refs must be a list").when(F.size("refs") == 0, "refs list is empty"),
        F.when(~F.coalesce(F.col("type").isin(*QA_CATEGORIES), F.lit(False)), F.concat(F.lit("Invalid type: "), F.coalesce("type", F.lit("None")))),
    ]
    found = F.filter(F.array(*checks), lambda m: m.isNotNull())
    return F.when(F.size(missing) > 0, missing).otherwise(found)


def with_keys(examples: DataFrame) -> DataFrame:
    """Typed examples as if every key were there."""
    return examples.withColumn("keys", F.array(*[F.lit(k) for k in REQUIRED]))


def validate_examples(examples: DataFrame, min_tokens: float = 50, max_tokens: float = 500) -> DataFrame:
    """id, issues of each example."""
    return checked(examples, min_tokens, max_tokens).select("id", "issues")


def checked(examples: DataFrame, min_tokens: float = 50, max_tokens: float = 500) -> DataFrame:
    """examples with issues; tokens are counted in a projection of their own, once a row."""
    df = examples if "keys" in examples.columns else with_keys(examples)
    df = df.withColumn("_tokens", token_estimate(F.coalesce("response", F.lit(""))))
    return df.withColumn("issues", issues_of(min_tokens, max_tokens, F.col("_tokens"))).drop("_tokens")


def reference_check(examples: DataFrame, node_ids: DataFrame) -> DataFrame:
    """id, ref, ok for each occurrence of a reference. node_ids has a column id."""
    refs = examples.select("id", F.explode("refs").alias("ref"))
    known = node_ids.select(F.col("id").alias("ref")).distinct().withColumn("ok", F.lit(True))
    return refs.join(known, "ref", "left").select("id", "ref", F.coalesce("ok", F.lit(False)).alias("ok"))


def duplicates(examples: DataFrame, order: str = "id") -> DataFrame:
    """kind, id of each example that repeats the id or the prompt of one before it.

    Keys are digests, so that whole prompts are read but not moved. Numbering within a key
    would sort a hot key in one task; the first of each key is found by a map-side combined
    minimum instead, and rows beyond it are kept.
    """
    digest = lambda text: F.unhex(F.sha2(text, 256))
    prompt = digest(F.lower(strip(F.coalesce("prompt", F.lit("")))))
    both = F.array(F.struct(F.lit("id").alias("kind"), digest(F.col("id")).alias("k")), F.struct(F.lit("prompt").alias("kind"), prompt.alias("k")))
    keyed = examples.select(F.explode(both).alias("key"), F.col(order).alias("o"), "id").select("key.*", "o", "id").filter("k IS NOT NULL")
    first = keyed.groupBy("kind", "k").agg(F.min("o").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
    return keyed.join(first, ["kind", "k"]).filter(F.col("o") > F.col("first")).select("kind", "id")


def type_distribution(examples: DataFrame) -> DataFrame:
    return examples.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("count"))


def dataset_report(examples: DataFrame, node_ids: DataFrame, min_tokens: float = 50, max_tokens: float = 500, order: str = "id") -> DataFrame:
    """One row of totals and the verdict."""
    v = validate_examples(examples, min_tokens, max_tokens).agg(
        F.count("*").alias("total_examples"), F.count_if(F.size("issues") == 0).alias("valid_examples"), F.count_if(F.size("issues") > 0).alias("invalid_examples")
    )
    r = reference_check(examples, node_ids).agg(F.count_if("ok").alias("valid_refs"), F.count_if(~F.col("ok")).alias("invalid_refs"))
    d = duplicates(examples, order).agg(F.count("*").alias("duplicates"))
    return v.join(r).join(d).withColumn("is_valid", (F.col("invalid_examples") + F.col("invalid_refs") + F.col("duplicates")) == 0)


def dataset_issues(examples: DataFrame, node_ids: DataFrame, min_tokens: float = 50, max_tokens: float = 500, order: str = "id", most: int = 10) -> DataFrame:
    """kind, issue: all issues of examples, and the first of wrong references and of duplicates (fixed texts)."""
    each = checked(examples, min_tokens, max_tokens).select(order, "id", F.explode("issues").alias("what"))
    each = each.select(F.lit("example").alias("kind"), F.concat(F.lit("Example "), F.col(order).cast("string"), F.lit(" ("), "id", F.lit("): "), "what").alias("issue"))
    wrong = reference_check(examples, node_ids).filter(~F.col("ok")).orderBy("id", "ref").limit(most)
    wrong = wrong.select(F.lit("reference").alias("kind"), F.concat(F.lit("Invalid node reference: "), "id", F.lit(": "), "ref").alias("issue"))
    again = duplicates(examples, order).orderBy("kind", "id").limit(most)
    again = again.select(F.lit("duplicate").alias("kind"), F.concat(F.when(F.col("kind") == "id", "Duplicate ID: ").otherwise("Duplicate prompt: "), "id").alias("issue"))
    return each.unionByName(wrong).unionByName(again)


def report(examples: DataFrame, node_ids: DataFrame, min_tokens: float = 50, max_tokens: float = 500, order: str = "id", shown: int = 1000) -> dict:
    """Totals, verdict, type distribution and at most so many issues, as a driver-side record."""
    out = dataset_report(examples, node_ids, min_tokens, max_tokens, order).first().asDict()
    out["type_distribution"] = {r["type"]: r["count"] for r in type_distribution(examples).collect()}
    out["issues"] = [r["issue"] for r in dataset_issues(examples, node_ids, min_tokens, max_tokens, order).orderBy("kind", "issue").limit(shown).collect()]
    return out


def gate(report: DataFrame) -> bool:
    """Whether a dataset may be written: only invalid examples stop it."""
    return report.first()["invalid_examples"] == 0


__all__ = ["PLACEHOLDERS", "Window", "dataset_issues", "dataset_report", "duplicates", "gate", "parse_examples", "reference_check", "report", "type_distribution", "validate_examples"]
