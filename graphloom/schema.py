"""Canonical schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabularies of the data model.
NODE_TYPES = ["module", "capability", "concept", "error", "recipe", "file", "class", "function", "variable", "external"]
RELATIONSHIPS = ["calls", "imports", "extends", "implements", "throws", "defined_in", "depends_on"]
SEMANTIC_TYPES = ["module", "capability", "concept", "error", "recipe"]
QA_CATEGORIES = ["discovery", "explain", "howto", "diagnostics"]
LANGUAGES = ["python", "java", "typescript", "javascript", "cpp", "c", "rust", "go"]

NODE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("path", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("properties", T.StringType(), False),
    ]
)
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("source_id", T.StringType(), False),
        T.StructField("target_id", T.StringType(), False),
        T.StructField("relationship", T.StringType(), False),
        T.StructField("weight", T.DoubleType()),
        T.StructField("properties", T.StringType()),
    ]
)
SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField(
            "context",
            T.StructType(
                [
                    T.StructField("file", T.StringType()),
                    T.StructField("language", T.StringType()),
                    T.StructField("neighbors", T.ArrayType(T.StringType())),
                    T.StructField("line", T.LongType()),
                    T.StructField("lines", T.StringType()),
                ]
            ),
        ),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
ERROR_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("error", T.StringType())])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
INSTRUCT_SCHEMA = T.StructType(
    [T.StructField("messages", T.ArrayType(MESSAGE)), T.StructField("metadata", T.StringType())]
)
