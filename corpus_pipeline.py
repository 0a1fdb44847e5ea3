"""A corpus pipeline: language, near duplicates, mixture, tokens.

Each stage takes the table that the one before it wrote. All but the last return the
columns of documents; the last returns the token ids of what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.op3_sentencepiece import encode_documents
from graphloom.llm.op6_language_id import keep_known
from graphloom.llm.op7_jaccard_join import deduplicate
from graphloom.llm.op8_mixing import mix
from graphloom.llm.staging import remove, scratch
from graphloom.session import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; what is rejected goes.

    Null, empty and letterless texts are rejected, and so are all texts where no labelled
    text could be learned from. Null ids, repeated rows and other columns, whatever their
    names, pass through; a tie goes to the first language and rejects nothing; very long
    texts are scored whole; an empty table stays empty.
    """
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Rows with a null doc_id stay, and of wordless texts one row a doc_id; of rows that
    repeat doc_id and text one stays; other columns pass through; very long texts are
    compared whole; an empty table stays empty.
    """
    return deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them; one that is taken twice is there twice.

    Null and wordless texts have size 0 and are not taken; a null source is a source, the
    last one; rows equal in all columns stand for each other; other columns pass through; an
    empty table stays empty.
    """
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of each row.

    A null text has null ids, an empty one none; null ids and repeated rows are returned
    like others; very long texts are encoded whole; other columns are not read; an empty
    table gives no rows.
    """
    return encode_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]
#: Trained models, sampling and a tokenizer are not SQL; the tests hold a run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again.

    A table goes when the next is written; of a run that fails, all go.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/graphloom/pipeline-{uuid.uuid4().hex}"
    before = None
    try:
        for name, stage in STAGES:
            with scratch(spark):
                stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
            if before:
                remove(spark, before)
            before = f"{base}/{name}"
    except BaseException:
        remove(spark, base)
        raise
    return docs
