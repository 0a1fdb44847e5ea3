"""License scan by diagonal voting.

Every rolling word K-gram of every text is joined by its hash to the places where a template holds
that gram; the words themselves are compared in the join, so equal hashes alone count for
nothing. A hit's diagonal is its place in the text less its place in the template: the hits of
one copy of a template lie on one diagonal, and words put in or left out move the rest of the copy
to a neighbouring one. Votes are counted per diagonal.

* A phrase, and every template under LONG words, stands where a diagonal has all its votes.
* For longer templates, diagonals of at least STRONG votes that lie at most GAP apart are merged to
  a span. It is verified by its longest chain of hits that rises in text and template: the
  words in the chain, divided by the template's, must come to SIMILAR.

Templates are a small fixed list and are broadcast; nothing else is. Texts are read once and not
shuffled; hits are grouped by row, so that no common gram gathers rows.

Results for edge cases: a null or empty text has no words; a very long text is cut into words and
grams in slices, all of it; a null doc_id stays null; repeated rows are each returned; places of
equal start count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.staging import few, prepare, scratch, stage, tidy

K = 2
LONG = 12
STRONG, GAP, SIMILAR = 2, 8, 0.8
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20
# The phrases asked for, by label.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
# Short forms and standard notices of public licenses, by label of their own.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("agpl-3.0", "GNU Affero General Public License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-notice", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit-text", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", "CC0 1.0 Universal"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-nd", "CC BY-ND"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
]
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """Words of the whole text, slice by slice; a slice ends where a word does."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    at = 0
    while at < len(data):
        cut = BREAK.search(data, at + SLICE)
        stop = cut.start() if cut else len(data)
        yield WORD.findall(data, at, stop)
        at = stop


def rolling(words: list[bytes], memory: dict[bytes, int], k: int = K) -> np.ndarray:
    """Hashes of all k-grams, rolled from the words' hashes."""
    if len(memory) > 1 << 18:
        memory.clear()
    known = memory.get
    each = []
    for w in words:
        h = known(w)
        if h is None:
            h = memory[w] = xxhash.xxh64_intdigest(w)
        each.append(h)
    one = np.array(each, np.uint64)
    out = one[: len(one) - k + 1].copy()
    for i in range(1, k):
        out = out * STEP + one[i : len(one) - k + 1 + i]
    return out.view(np.int64)


SCANNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("place", pa.int64()), ("hash", pa.int64()), ("gram", pa.binary())])
SCANNED_DDL = "row long, doc_id long, n_words long, place long, hash long, gram binary"


def scan(k: int = K):
    """A row for each k-gram (place, hash, gram), and one for each text (doc_id, n_words)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, memory = TaskContext.get().partitionId() << 33, {}
        for part in parts:
            heads: list[tuple] = []
            for doc, text in zip(part.column("doc_id"), part.column("text"), strict=True):
                n, held = 0, []
                for new in words_of(text.as_py()):
                    words = held + new
                    first, n = n - len(held), n + len(new)
                    if len(words) >= k:
                        grams = words[: len(words) - k + 1] if k == 1 else list(map(b" ".join, zip(*[words[i:] for i in range(k)], strict=False)))
                        m = len(grams)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, row)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.arange(first, first + m)), pa.array(rolling(words, memory, k)), pa.array(grams, pa.binary())], schema=SCANNED)
                    held = words[len(words) - k + 1 :] if k > 1 else []
                heads.append((row, doc.as_py(), n, None, None, None))
                row += 1
            if heads:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*heads, strict=True), SCANNED.types, strict=True)], schema=SCANNED)

    return tidy(run)


def template_places(spark: SparkSession, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """template, at, hash, gram of every k-gram of the templates."""
    rows = []
    for i, (_, text) in enumerate(templates):
        words = [w for part in words_of(text) for w in part]
        if len(words) < k:
            raise ValueError(f"template {text!r} has fewer than {k} words")
        hashes = rolling(words, {}, k)
        rows += [(i, at, int(hashes[at]), b" ".join(words[at : at + k])) for at in range(len(hashes))]
    return spark.createDataFrame(rows, "template int, at long, t_hash long, t_gram binary")


def lengths(spark: SparkSession, templates: list[tuple[str, str]], base: int, long: int) -> DataFrame:
    """template, label, base, words, whole (it must stand in full)."""
    n = [sum(map(len, words_of(text))) for _, text in templates]
    return spark.createDataFrame([(i, label, i < base, n[i], i < base or n[i] < long) for i, (label, _) in enumerate(templates)], "t int, label string, base boolean, words int, whole boolean")


def chain_words(places: list[int], at: list[int], k: int) -> int:
    """Template words in the longest chain of hits that rises in text and template."""
    order = sorted(range(len(at)), key=lambda i: (places[i], -at[i]))
    ends: list[int] = []  # smallest last template place of a chain of each length
    last: list[int] = []  # its hit
    before: list[int] = [-1] * len(at)
    for i in order:
        j = bisect_left(ends, at[i])
        before[i] = last[j - 1] if j else -1
        if j == len(ends):
            ends.append(at[i])
            last.append(i)
        else:
            ends[j], last[j] = at[i], i
    covered: set[int] = set()
    i = last[-1] if last else -1
    while i >= 0:
        covered.update(range(at[i], at[i] + k))
        i = before[i]
    return len(covered)


def verify(k: int):
    def run(hits: pd.DataFrame) -> pd.DataFrame:
        one = hits.iloc[0]
        held = chain_words(hits["place"].tolist(), hits["at"].tolist(), k)
        return pd.DataFrame([(one["row"], one["template"], hits["place"].min(), hits["place"].max() + k, held / one["words"])], columns=["row", "template", "first", "stop", "share"])

    return run


def spans(hits: DataFrame, about: DataFrame, k: int = K) -> DataFrame:
    """row, template, first, stop, share of every verified span of hits (row, template, place, at)."""
    hits = hits.withColumn("diagonal", F.col("place") - F.col("at"))
    votes = hits.groupBy("row", "template", "diagonal").agg(F.count("*").alias("votes"), F.min("place").alias("first"))
    votes = votes.join(about, F.col("template") == F.col("t"))
    full = votes.filter(F.col("whole") & (F.col("votes") == F.col("words") - (k - 1)))
    full = full.select("row", "template", "first", (F.col("first") + F.col("words")).alias("stop"), F.lit(1.0).alias("share"))
    each = Window.partitionBy("row", "template").orderBy("diagonal")
    strong = votes.filter(~F.col("whole") & (F.col("votes") >= STRONG)).withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(each) <= GAP, 0).otherwise(1))
    strong = strong.withColumn("span", F.sum("new").over(each)).select("row", "template", "diagonal", "votes", "span", "words")
    enough = strong.withColumn("all", F.sum("votes").over(Window.partitionBy("row", "template", "span"))).filter(F.col("all") >= SIMILAR / 2 * F.col("words"))
    chained = hits.join(enough.select("row", "template", "diagonal", "span", "words"), ["row", "template", "diagonal"]).groupBy("row", "template", "span").applyInPandas(verify(k), "row long, template int, first long, stop long, share double")
    return full.unionByName(chained.filter(F.col("share") >= SIMILAR))


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged texts (row, doc_id, n_words), spans, and about (t, label, base, words, whole) of templates after phrases."""
    spark, phrases = docs.sparkSession, PHRASES if phrases is None else phrases
    every = [*phrases, *(TEMPLATES if templates is None else templates)]
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    grams = given.mapInArrow(scan(k), SCANNED_DDL)
    known = F.broadcast(template_places(spark, every, k))
    met = grams.join(known, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left").filter("n_words IS NOT NULL OR template IS NOT NULL")
    met = stage(met.select(F.col("n_words").isNull().alias("hit"), "row", "doc_id", "n_words", "template", "place", "at"), "grams", "hit")
    about = F.broadcast(lengths(spark, every, len(phrases), LONG))
    found = stage(spans(met.filter("hit").select("row", "template", "place", "at"), about, k), "spans")
    return met.filter("NOT hit").select("row", "doc_id", "n_words"), found, about


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, k: int = K) -> DataFrame:
    """One row for each row of docs (doc_id, text): places of the phrases, and all labels."""
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        texts, found, about = license_spans(docs, templates, phrases, k)
        named = found.join(about, F.col("template") == F.col("t"))
        joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
        base = F.when(F.col("base"), F.col("first"))
        per = named.groupBy(F.col("row").alias("r")).agg(
            F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"), joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("share").alias("score"), F.count("*").alias("n_spans")
        )
        out = texts.join(few(stage(per, "labels")), F.col("row") == F.col("r"), "left")
        zero, none = F.lit(0).cast("bigint"), F.lit("")
        return keep(
            out.select("doc_id", "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_spans", zero).alias("n_spans")),
            "licenses",
        )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The part that SQL can state: words and places of the phrases.
BASE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT unnest(['gpl', 'apache', 'cc-by', 'mit']) AS label, unnest([['gnu', 'general', 'public', 'license'], ['apache', 'license'], ['cc', 'by'], ['mit', 'license']]) AS phrase),
h AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1] = phrase[1] AND list_slice(w, i + 1, i + len(phrase)) = phrase)) AS i FROM d, p),
g AS (SELECT r, count(*) AS n, min(i) AS f, max(i) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f AS first_word, l AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g ON d.r = g.r
"""
