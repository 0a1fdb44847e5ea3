"""Registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import op1_token_counts as op1
from graphloom.llm import op2_topk_search as op2
from graphloom.llm import op3_sentencepiece as op3
from graphloom.llm import op4_warc as op4
from graphloom.llm import op5_sharding as op5
from graphloom.llm import op6_language_id as op6
from graphloom.llm import op7_jaccard_join as op7
from graphloom.llm import op8_mixing as op8
from graphloom.llm import op9_page_differencing as op9
from graphloom.llm import op10_media_sequences as op10
from graphloom.llm import op11_prefix_trie as op11
from graphloom.llm import op12_license_scan as op12
from graphloom.llm import op13_merkle_manifest as op13

REGISTRY = {
    "op1_token_counts": op1.op1_token_counts,
    "op2_topk_search": op2.op2_topk_search,
    "op3_sentencepiece": op3.op3_sentencepiece,
    "op4_warc": op4.op4_warc,
    "op5_sharding": op5.op5_sharding,
    "op6_language_id": op6.op6_language_id,
    "op7_jaccard_join": op7.op7_jaccard_join,
    "op8_mixing": op8.op8_mixing,
    "op9_page_differencing": op9.op9_page_differencing,
    "op10_media_sequences": op10.op10_media_sequences,
    "op11_prefix_trie": op11.op11_prefix_trie,
    "op12_license_scan": op12.op12_license_scan,
    "op13_merkle_manifest": op13.op13_merkle_manifest,
}


def mixing_targets(spark, sf_dir):
    """What op8 decides before any draw: sizes and targets."""
    got = op8.op8_mixing(spark, sf_dir)
    return got.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def media_digests(spark, sf_dir):
    """What op10 reads back, without its features and checksum."""
    return op10.op10_media_sequences(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


def license_places(spark, sf_dir):
    """What op12 says of the phrases alone."""
    return op12.op12_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


REGISTRY |= {"license_places": license_places, "mixing_targets": mixing_targets, "media_digests": media_digests}
TARGETS = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
k AS (SELECT *, 2 * source_size::DOUBLE AS cap, 2 * source_size / w AS height FROM p),
l AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM p) - (SELECT coalesce(sum(cap), 0) FROM k o WHERE o.height < k.height)) / (SELECT sum(w) FROM k o WHERE o.height >= k.height) AS level FROM k),
t AS (SELECT source, source_size, CASE WHEN height <= level THEN cap ELSE w * (SELECT arg_min(level, height) FROM l WHERE height > level) END AS target FROM l)
SELECT doc_id, size, source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
DIGESTS = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b)::BIGINT AS n_bytes, (greatest(1, ceil(octet_length(b) / 576.0)) * 576)::BIGINT AS payload_bytes FROM d),
p AS (SELECT doc_id, n_bytes, payload_bytes, b || repeat('\xFF'::BLOB, payload_bytes - n_bytes) AS payload, encode('P5' || chr(10) || '24 ' || payload_bytes // 24 || chr(10) || '255' || chr(10)) AS head FROM n)
SELECT doc_id, n_bytes, payload_bytes, sha256(payload) AS payload_sha256, (octet_length(head) + payload_bytes)::BIGINT AS media_bytes, sha256(head || payload) AS media_sha256 FROM p
"""
ORACLE = {"mixing_targets": TARGETS, "media_digests": DIGESTS, "op2_topk_search": op2.ORACLE, "op4_warc": op4.ORACLE, "op5_sharding": op5.ORACLE, "op7_jaccard_join": op7.ORACLE, "license_places": op12.BASE, "op11_prefix_trie": op11.ORACLE, "op13_merkle_manifest": op13.ORACLE}
