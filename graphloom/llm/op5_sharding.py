"""Extendible hashing: shards by hash-prefix bits, split only where they are too large.

A document's hash is 60 bits of the MD5 of its doc_id. The directory is computed from the
bytes below each prefix: cells of a depth chosen from the total size are summed once,
rolled up to shorter prefixes as long as some bucket of these fits, and a bucket is a shard at the
shortest prefix that fits the limit: what is larger is split on one more bit. Where a cell itself is too large the next bits are taken, for its rows
alone. A bucket whose rows share one hash is split on a second hash, of the row's number
in the staged table. All of it is joins and sums of the DataFrame API; the directory is
a table like any other, joined and not broadcast.

Results for edge cases: a null text has 0 bytes; a null doc_id hashes as the empty
string; a row larger than the limit, however long its text, is a shard by itself; repeated rows, even a third of
the table under one doc_id, are split by the second hash; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.staging import scratch, stage

LIMIT = 4 << 20  # bytes of a shard
BITS = 60
SLACK_BITS = 5  # of a cell beyond the depth that even splitting needs
ROLL = 8  # bits by which cells are rolled up at once
MORE_BITS = 10  # taken at once below a cell that is too large


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def prefix(h: Column, depth: Column) -> Column:
    """The first depth of the bits."""
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def shard_depths(rows: DataFrame, h: str, low: int, high: int, limit: int) -> DataFrame:
    """cell (the first high bits), depth, fits, one: the shard of each cell, at a depth in [low, high].

    rows: h, n_bytes. A bucket is final if it fits or holds one hash only.
    """
    cells = rows.groupBy(prefix(F.col(h), F.lit(high)).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.min(h).alias("lo"), F.max(h).alias("hi"))
    return directory(stage(cells, "cells"), low, high, limit)


def directory(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """shard_depths of cells (cell, b, lo, hi).

    Cells are rolled up to the prefixes of the next ROLL bits above them. A bucket that is final has
    final parts, so that only where some bucket of the shortest of these prefixes is final,
    longer rolls are needed, and these begin from the sums of that depth.
    """
    floor = max(low, high - ROLL)
    up = cells.withColumn("depth", F.explode(F.sequence(F.lit(floor), F.lit(high)))).withColumn("bucket", F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int")))
    buckets = up.groupBy("depth", "bucket").agg(F.sum("b").alias("b"), (F.min("lo") == F.max("hi")).alias("one")).filter((F.col("b") <= limit) | F.col("one") | (F.col("depth") == high))
    final = up.select("cell", "depth", "bucket").join(buckets.select("depth", "bucket", (F.col("b") <= limit).alias("fits"), "one"), ["depth", "bucket"])
    got = final.groupBy("cell").agg(F.min(F.struct("depth", "fits", "one")).alias("x")).select("cell", "x.*")
    if floor == low:
        return got
    got = stage(got, "directory")
    if got.filter((F.col("depth") == floor) & (F.col("fits") | F.col("one"))).isEmpty():
        return got
    above = F.call_function("shiftright", F.col("cell"), F.lit(high - floor))
    coarse = stage(cells.groupBy(above.alias("cell")).agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "cells")
    more = directory(coarse, low, floor, limit).select(F.col("cell").alias("_c"), F.struct("depth", "fits", "one").alias("_x"))
    here = F.struct("depth", "fits", "one")
    at_floor = F.col("depth") == floor
    return got.withColumn("_p", above).join(more, F.col("_p") == F.col("_c")).select("cell", F.when(at_floor, F.col("_x")).otherwise(here).alias("x")).select("cell", "x.*")


def extend(rows: DataFrame, h: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their depth on hash h, and those left in buckets of one hash that do not fit."""
    total = rows.agg(F.sum("n_bytes")).first()[0]
    depth = min(BITS, ((total or 0) // limit).bit_length() + SLACK_BITS)
    done, low, todo = None, 0, rows
    while True:
        got = stage(shard_depths(todo, h, low, depth, limit), "directory")
        placed = stage(todo.withColumn("cell", prefix(F.col(h), F.lit(depth))).join(got, "cell").drop("cell"), "shards")
        part = placed.filter("fits or one")
        done = part if done is None else done.unionByName(part)
        todo = placed.filter("not fits and not one").drop("depth", "fits", "one")
        if depth == BITS or not todo.head(1):
            break
        low, depth = depth, min(BITS, depth + MORE_BITS)
    over = done.filter("not fits")
    return done.filter("fits").drop("fits", "one"), over.drop("depth", "fits", "one")


def bits_text(h: str, depth: Column) -> Column:
    return F.substring(F.lpad(F.bin(F.col(h)), BITS, "0"), F.lit(1), depth.cast("int"))


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, shard_docs of every row of docs (doc_id, text); staged."""
    with scratch(docs.sparkSession) as keep:
        return keep(_shard(docs, limit), "sharded")


def _shard(docs: DataFrame, limit: int) -> DataFrame:
    rows = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), hash_bits(F.col("doc_id")).alias("h"),
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS).alias("h2"),
    )
    rows = stage(rows, "sizes")
    fitting, over = extend(rows, "h", limit)
    named = fitting.select("doc_id", "n_bytes", bits_text("h", F.col("depth")).alias("shard"), F.col("depth").cast("int").alias("depth"))
    if over.head(1):  # one hash holds more than a shard
        named = named.unionByName(split_again(over, limit))
    sums = named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return named.join(sums, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


def split_again(over: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hash, split on the bits of the second hash, which differs from row to row.

    All such rows share the depth that their largest group needs.
    """
    groups = over.groupBy("h").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    depth = F.when(F.col("n") == 1, 0).otherwise(F.ceil(F.log2(F.col("b") / F.lit(float(limit)))) + 1).cast("int")
    rows = over.join(groups.select("h", depth.alias("d")), "h")
    step = 0
    done = None
    while True:  # a bit more where a part is still too large
        part = rows.withColumn("p", F.call_function("shiftright", F.col("h2"), (F.lit(BITS) - F.col("d")).cast("int")))
        big = part.groupBy("h", "p").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).select("h", "p", ((F.col("b") > limit) & (F.col("n") > 1)).alias("big"))
        part = stage(part.join(big, ["h", "p"]), "split")
        ok = part.filter("not big")
        done = ok if done is None else done.unionByName(ok)
        step += 1
        if step == BITS or not part.filter("big").head(1):
            break
        rows = part.filter("big").drop("p", "big").withColumn("d", F.least(F.col("d") + 1, F.lit(BITS)))
    tail = F.substring(F.lpad(F.bin(F.col("h2")), BITS, "0"), F.lit(1), F.col("d"))
    return done.select("doc_id", "n_bytes", F.concat(bits_text("h", F.lit(BITS)), F.lit("+"), tail).alias("shard"), (F.lit(BITS) + F.col("d")).cast("int").alias("depth"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
u AS (SELECT doc_id, n_bytes, h, unnest(range(0, 31)) AS depth FROM d),
b AS (SELECT depth, h >> (60 - depth)::INTEGER AS bucket, sum(n_bytes) AS s, count(*) AS n, count(DISTINCT h) AS k FROM u GROUP BY 1, 2),
f AS (SELECT doc_id, any_value(n_bytes) AS n_bytes, any_value(h) AS h, min(u.depth) AS depth FROM u JOIN b ON b.depth = u.depth AND b.bucket = u.h >> (60 - u.depth)::INTEGER WHERE s <= {LIMIT} OR k = 1 GROUP BY doc_id)
SELECT doc_id, f.n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE substr(lpad(bin(h), 60, '0'), 1, f.depth) END AS shard, f.depth::INTEGER AS depth, s::BIGINT AS shard_bytes, n AS shard_docs
FROM f JOIN b ON b.depth = f.depth AND b.bucket = h >> (60 - f.depth)::INTEGER
"""
