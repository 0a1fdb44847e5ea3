"""WARC archives: chunked, segmented and revisit records, and their reassembly.

Archives are written as gzip members, one a record, rolled at a size limit, and kept as
rows of a staged table (name, content), so that Spark's committer covers them. A block
longer than a segment is continued in continuation records. Reading parses each archive
by itself; only segments are shuffled, by their origin's identifier, put in order of
their number, checked against the total length and then decoded from chunked framing.

Results for edge cases: a null html is an empty payload; payloads below the limit are
never revisits; a null page_id is written as response; rows that repeat a page_id are
each written once, each payload is a revisit or response by itself, and where the page_id
is the largest of its payload each is the response; a null url is empty; very long payloads
are segmented, and held whole only where their segments meet; an empty table gives no rows;
other columns, whatever their names, are not read. A revisit must refer to a response with
its digest and length, or reading fails.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.staging import few, prepare, scratch, stage

REVISIT_BYTES = 1000
CHUNK = 8 << 10  # of the chunked transfer framing
SEGMENT = 16 << 10  # of a record's block
ARCHIVE = 4 << 20  # bytes at which an archive is closed
RAW = 16 << 20  # bytes before compression at which it is closed too
READ = 8 << 20  # bytes of segments handed on at once
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class WarcError(ValueError):
    """An archive that breaks the format."""


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(part), part) for i in range(0, len(payload), size) if (part := payload[i : i + size])]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The body in chunked framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise WarcError("a chunk has no size line")
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise WarcError("a chunk is cut short")
        out.append(data[at : at + size])
        at += size + 2


def record(fields: dict[str, object], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def page_records(page: int | None, url: str, payload: bytes, digest: str, refers: int | None, serial: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """Members of one page: a revisit, a response, or a response and its continuations."""
    name = f"<urn:x-page:{'' if page is None else page}#{serial}>"
    fields = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Target-URI": " ".join(url.split()), "WARC-Date": DATE, "WARC-Payload-Digest": "sha1:" + digest, "Content-Type": "application/http; msgtype=response"}
    if refers is not None:
        fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers}>"}
        yield record(fields, HTTP + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield record(fields, block)
        return
    yield record(fields | {"WARC-Segment-Number": 1}, parts[0])
    for i, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"{name[:-1]}.{i}>", "WARC-Date": DATE, "WARC-Segment-Number": i, "WARC-Segment-Origin-ID": name}
        yield record(more | ({"WARC-Segment-Total-Length": len(block)} if i == len(parts) else {}), part)


def write_archives(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task = TaskContext.get().partitionId()
    held, size, raw, archives, n = [], 0, 0, 0, 0
    for part in parts:
        for page, url, html, digest, refers in zip(part["page_id"], part["url"], part["html"], part["digest"], part["refers_to"], strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            n += 1
            for member in page_records(None if pd.isna(page) else int(page), url or "", payload, digest, None if pd.isna(refers) else int(refers), f"{task}.{n}"):
                held.append(member)
                size += len(member)
                raw += min(len(payload), SEGMENT)
                if size >= ARCHIVE or raw >= RAW:
                    yield pd.DataFrame({"archive": [f"part-{task:05d}-{archives:05d}.warc.gz"], "content": [b"".join(held)]})
                    held, size, raw, archives = [], 0, 0, archives + 1
    if held:
        yield pd.DataFrame({"archive": [f"part-{task:05d}-{archives:05d}.warc.gz"], "content": [b"".join(held)]})


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    while data:
        member = zlib.decompressobj(31)
        raw = member.decompress(data) + member.flush()
        if not member.eof:
            raise WarcError("an archive member is cut short")
        data = member.unused_data
        head, gap, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not gap or not lines[0].startswith("WARC/"):
            raise WarcError("a record has no header")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(fields["Content-Length"])
        if rest[size:] != b"\r\n\r\n":
            raise WarcError("a record's length is wrong")
        yield fields, rest[:size]


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


RECORDS = "origin string, number int, total long, page_id long, payload_bytes long, payload_digest string, stated string, record_type string, refers_to long, block binary"
COLUMNS = [f.split()[0] for f in RECORDS.split(", ")]


def page_of(name: str) -> int | None:
    text = name[len("<urn:x-page:") :].rstrip(">").split("#")[0]
    return int(text) if text else None


def read_row(fields: dict[str, str], block: bytes) -> tuple:
    """A finished row, or a segment with its block."""
    kind, name = fields["WARC-Type"], fields["WARC-Record-ID"]
    stated = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if "WARC-Segment-Number" in fields:
        first = kind != "continuation"
        total = fields.get("WARC-Segment-Total-Length")
        return (name if first else fields["WARC-Segment-Origin-ID"], int(fields["WARC-Segment-Number"]), int(total) if total else None, page_of(name) if first else None, None, None, stated if first else None, kind, None, block)
    if kind == "revisit":
        head = dict(x.split(b": ", 1) for x in block.split(b"\r\n")[1:] if b": " in x)
        return (None, None, None, page_of(name), int(head[b"Content-Length"]), stated, stated, kind, page_of(fields["WARC-Refers-To"]), None)
    payload = payload_of(block)
    return (None, None, None, page_of(name), len(payload), hashlib.sha1(payload).hexdigest(), stated, kind, None, None)


def read_archives(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for content in part["content"]:
            rows, size = [], 0
            for fields, block in parse_archive(content):
                rows.append(read_row(fields, block))
                size += len(rows[-1][-1] or b"")
                if size >= READ:
                    yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)


def reassemble(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of records whose segments were gathered: pieces is an array of (number, block)."""
    for part in parts:
        rows = []
        for origin, page, stated, total, pieces in zip(part["origin"], part["page_id"], part["stated"], part["total"], part["pieces"], strict=True):
            if [p["number"] for p in pieces] != list(range(1, len(pieces) + 1)):
                raise WarcError(f"segments of {origin} are missing or repeated")
            block = b"".join(p["block"] for p in pieces)
            if pd.isna(total) or len(block) != int(total):
                raise WarcError(f"length of {origin} is not its stated total")
            payload = payload_of(block)
            rows.append((None if pd.isna(page) else int(page), len(payload), hashlib.sha1(payload).hexdigest(), stated, "response", None))
        yield pd.DataFrame(rows, columns=COLUMNS[3:9], dtype=object)


def digests(pages: DataFrame) -> DataFrame:
    """pages with digest and refers_to, the page that holds an equal payload's response."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    light = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    big = light.filter(F.col("n") >= REVISIT_BYTES)
    best = big.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("m")).filter("m > 1").drop("m")
    best = stage(best, "kept")  # both sides of the join are then exchanges, and a hot digest can be split
    again = big.join(best, "digest").filter("page_id < keep").select("page_id", "digest", F.col("keep").alias("refers_to")).distinct()
    # a page_id can have several payloads; with it in the key a hot digest stays spread
    return pages.select("page_id", "url", "html", F.sha1(payload).alias("digest")).join(again, ["page_id", "digest"], "left")


def write_warc(pages: DataFrame) -> DataFrame:
    """The staged archives of pages (page_id, url, html)."""
    given = digests(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"))
    return stage(given.mapInPandas(write_archives, "archive string, content binary"), "warc")


def read_warc(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    rows = stage(archives.select("content").mapInPandas(read_archives, RECORDS), "records")
    done = rows.filter("number is null").select(*COLUMNS[3:9])
    pieces = F.array_sort(F.collect_list(F.struct("number", "block"))).alias("pieces")
    whole = rows.filter("number is not null").groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("stated").alias("stated"), F.max("total").alias("total"), pieces)
    got = done.unionByName(whole.mapInPandas(reassemble, "page_id long, payload_bytes long, payload_digest string, stated string, record_type string, refers_to long"))
    checked = F.when(F.col("payload_digest") == F.col("stated"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not have its stated digest")))
    read = stage(got.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to"), "read")
    return read.filter("record_type <> 'revisit'").unionByName(resolved(read))


def resolved(read: DataFrame) -> DataFrame:
    """The revisits, each of which must refer to a response with its payload's digest and length."""
    known = read.filter("record_type <> 'revisit'").select(F.col("page_id").alias("to"), F.col("payload_digest").alias("its"), F.col("payload_bytes").alias("size"))
    known = stage(known.join(read.filter("record_type = 'revisit'").select(F.col("refers_to").alias("to")).distinct(), "to", "left_semi").distinct(), "responses")
    same = (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("its")) & (F.col("payload_bytes") == F.col("size"))
    found = read.filter("record_type = 'revisit'").join(few(known), same, "left")
    to = F.when(F.col("to").isNotNull(), F.col("refers_to")).otherwise(F.raise_error(F.lit("a revisit refers to no response with its payload")).cast("bigint"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", to.alias("refers_to"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    with scratch(spark) as keep:
        return keep(read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))), "read")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
b AS (SELECT d, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keep THEN keep END AS refers_to
FROM p LEFT JOIN b ON p.d = b.d AND n >= 1000
"""
