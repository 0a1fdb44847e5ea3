"""Interleaved document sequences: text and media references of HTML, resolved by digest.

A text's payload is its UTF-8 bytes, filled with bytes 255 to whole tiles of 24 x 24, and is
stored as an 8-bit greyscale image (binary portable graymap) in a media table keyed by
the SHA-256 of the stored file. Its document is HTML that interleaves text with a figure:
the reference by digest, and a caption. Reading parses the HTML into ordered structs
(position, kind, text, ref, caption), computes features where the stored files lie, and
resolves the references by a join on digests, so payloads are never shuffled; position
and caption stay with their reference. A reference that nothing resolves fails the run.

Results for edge cases: a null or empty text is one tile of 255s with n_bytes 0; a very long text
is one file, made and read back whole by the task that holds its row; equal
texts share one file; a null doc_id stays null; repeated rows are each returned; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.staging import prepare, scratch, stage

SIDE = 24
TILE = SIDE * SIDE
FILL = b"\xff"
HEADER = re.compile(rb"P5\s(\d+)\s(\d+)\s255\s")
PIECES = re.compile(r"<(/?)(figure|figcaption|p|h[1-6]|li|img|audio|video|source)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)|<[^>]*>", re.I | re.S)
SOURCE = re.compile(r"\bsrc\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+))", re.I)
SCHEME = "digest:sha256:"
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"


def to_payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + FILL * (-len(data) % TILE or (0 if data else TILE))


def to_image(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (SIDE, len(payload) // SIDE) + payload


def from_image(stored: bytes) -> bytes:
    m = HEADER.match(stored)
    if not m or len(stored) - m.end() != int(m[1]) * int(m[2]):
        raise ValueError("not a whole image of 8-bit samples")
    return stored[m.end() :]


def parse_sequence(page: str) -> list[dict]:
    """Text blocks and media references of an HTML document, in order.

    A reference inside a figure takes the figure's caption; a caption before its image
    waits for it.
    """
    out: list[dict] = []
    held: list[str] = []
    caption: list[str] | None = None  # being read
    early = None  # a caption that stands before its figure's image
    figure: list[int] | None = None  # references of the figure that is open

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append({"position": len(out), "kind": "text", "text": text, "ref": None, "caption": None})

    for m in PIECES.finditer(page):
        if m[4] is not None:
            (held if caption is None else caption).append(m[4])
            continue
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name == "figcaption" and not closing:
            flush()
            caption = []
        elif name == "figcaption":
            early = " ".join(entities.unescape("".join(caption or [])).split())
            caption = None
            for i in figure or []:
                out[i]["caption"] = early
        elif name == "figure":
            flush()
            caption, early, figure = None, None, None if closing else []
        elif name in ("img", "audio", "video", "source"):
            if not closing and (s := SOURCE.search(m[3])):
                flush()
                if figure is not None:
                    figure.append(len(out))
                out.append({"position": len(out), "kind": "media", "text": None, "ref": entities.unescape(s[1] or s[2] or s[3] or ""), "caption": early})
        else:
            flush()
    flush()
    return out


def document(name: str, digest: str, size: int) -> str:
    """HTML of one document: its heading, its figure, and a closing line."""
    say = entities.escape
    return f'<article><h1>{say(name)}</h1><figure><img src="{SCHEME}{digest}" alt=""><figcaption>{say(name)}, {size} bytes</figcaption></figure><p>End of {say(name)}</p></article>'


STORED = "kind int, doc_id long, page string, digest string, media binary"


def store(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A document row for each text and a media row for each file that the task has not stored."""
    seen: set[str] = set()
    for part in parts:
        docs, files = [], []
        for doc, text in zip(part["doc_id"], part["text"], strict=True):
            payload = to_payload(text)
            media = to_image(payload)
            digest = hashlib.sha256(media).hexdigest()
            name = f"document {'' if pd.isna(doc) else int(doc)}"
            docs.append((0, None if pd.isna(doc) else int(doc), document(name, digest, len(payload)), digest, None))
            if digest not in seen:
                if len(seen) < 1 << 20:
                    seen.add(digest)
                files.append((1, None, None, digest, media))
        for i in range(0, len(files), 200):
            yield pd.DataFrame(files[i : i + 200], columns=["kind", "doc_id", "page", "digest", "media"]).astype({"doc_id": "Int64"})
        yield pd.DataFrame(docs, columns=["kind", "doc_id", "page", "digest", "media"]).astype({"doc_id": "Int64"})


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature_of(payload: bytes) -> str:
    """Tiles, mean sample and the shares of six ranges of samples, in thousandths."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    total = len(payload)
    mean = int((counts * np.arange(256)).sum()) * 1000 // total
    parts = [int(counts[a:b].sum()) * 1000 // total for a, b in ((0, 32), (32, 65), (65, 97), (97, 128), (128, 255), (255, 256))]
    return f"tiles={total // TILE};mean={mean};hist=" + ",".join(map(str, parts))


def compute_features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for digest, media in zip(part["digest"], part["media"], strict=True):
            media = bytes(media)
            sha = hashlib.sha256(media).hexdigest()
            if sha != digest:
                raise ValueError(f"stored file {digest} has changed")
            payload = from_image(media)
            rows.append((digest, len(payload.rstrip(FILL)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha, feature_of(payload)))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in FEATURES.split(", ")])


def sequences(pages: DataFrame) -> DataFrame:
    """pages (with a column page) with their sequence of structs."""

    @F.pandas_udf(SEQUENCE)
    def parse(page: pd.Series) -> pd.Series:
        return page.map(lambda p: parse_sequence(p or ""))

    return pages.withColumn("sequence", parse("page"))


def resolve(sequence: DataFrame, features: DataFrame, keep: list[str]) -> DataFrame:
    """One row a media reference: keep, position, caption, items and the features of its file."""
    refs = sequence.select(*keep, F.size("sequence").alias("items"), F.explode(F.filter("sequence", lambda x: (x["kind"] == "media") & x["ref"].startswith(SCHEME))).alias("m"))
    refs = refs.select(*keep, "items", F.col("m.position").alias("position"), F.col("m.caption").alias("caption"), F.substring("m.ref", len(SCHEME) + 1, 64).alias("digest"))
    known = features.select(F.col("digest").alias("_d"), *[c for c in features.columns if c != "digest"])
    joined = refs.join(known, F.col("digest") == F.col("_d"), "left")
    found = F.when(F.col("_d").isNotNull(), F.col("media_sha256")).otherwise(F.raise_error(F.concat(F.lit("no stored file has digest "), "digest")))
    return joined.withColumn("media_sha256", found).drop("_d", "digest")


def store_and_read(docs: DataFrame) -> DataFrame:
    """Store the texts of docs (doc_id, text) as media of HTML documents, and read them back."""
    prepare(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with scratch(docs.sparkSession) as keep:
        return keep(_read_back(stage(given.mapInPandas(store, STORED), "media", "kind")), "resolved")


def _read_back(stored: DataFrame) -> DataFrame:
    every = stored.filter("kind = 1").select("digest", "media").mapInPandas(compute_features, FEATURES)
    rest = [c for c in FEATURES.replace(",", "").split()[::2] if c != "digest"]
    features = stage(every.groupBy("digest").agg(*[F.first(c).alias(c) for c in rest]), "features")
    return resolve(sequences(stored.filter("kind = 0").select("doc_id", "page")), features, ["doc_id"])


def op10_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
