"""Prefix trie of conversations: nodes by chained digests, subtree sums over ancestors.

Each turn becomes a digest of its role and text; texts are not moved. Along a conversation
the digests are chained, so the digest at depth d names its first d turns. Every prefix is a
row, and the rows that agree in (depth, digest) are a node; its representative is the smallest
conversation that starts with it. A node's ancestors are the shorter prefixes of its
representative: each node is exploded to them and adds its leaf and saving to each.

No conversation, and no node, has to fit in a task:

* Places of turns come from ranges (places.numbered). Chains are computed in segments of
  SEGMENT turns; the digest that a segment starts from is chained over the segments' last digests.
* Nodes deeper than WINDOW are exploded to the ancestors of their window of depths only; nodes
  at the windows' tops then carry their window's sum to the windows above, WINDOW times as large
  each time. A node has at most WINDOW ancestors a round, and rounds grow with the logarithm of
  the depth.
* Ids of conversations that end at a node are sorted by ranges, joined in pieces, and hashed
  piece after piece.

Results for edge cases: a null conv_id takes no part; a null turn comes first, equal turns are in
the order of role and text, repeated rows are turns of their own; null role and text are empty;
very long texts are hashed whole by the engine; a conversation without turns is a member of the
root only; an empty table gives no rows, not even a root; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.places import numbered
from graphloom.llm.staging import few, partitions, prepare, scratch, stage

SEGMENT = 512
WINDOW = 32
#: Bytes of ids that a piece holds.
PIECE = 1 << 16
# Fixed values of the rebuilding: donors are multiples of it, and lead turns are fewer than it.
DONORS, LEADS = 100, 6


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, digest, points, place, width of every turn, staged; texts only where they order equal turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    light = stage(whole.select("conv_id", "turn", "role", digest.alias("digest"), F.length("text").cast("bigint").alias("points")), "turns")
    tied = light.groupBy("conv_id", "turn", "role").agg(F.min(F.xxhash64("digest")).alias("a"), F.max(F.xxhash64("digest")).alias("b")).filter("a <> b")
    tied = few(stage(tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r")), "tied"))
    same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r"))
    if tied.isEmpty():
        light = light.withColumn("tie", F.lit(None).cast("string"))
    else:
        light = stage(whole.withColumn("digest", digest).withColumn("points", F.length("text").cast("bigint")).join(tied, same, "left").select("conv_id", "turn", "role", "digest", "points", F.when(F.col("c").isNotNull(), F.col("text")).alias("tie")), "turns")
    return stage(numbered(light, ["conv_id"], ["turn", "role", "tie", "digest"], "ordered").select("conv_id", "digest", "points", "place", "width"), "placed")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and turns (conv_id, place, digest, points) as they are."""
    return turns.filter("place = 0").select("conv_id", F.col("width").alias("length")), turns.select("conv_id", "place", "digest", "points")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same, each conversation begun with turns of its donor.

    Conversation c takes the first h turns of conversation c - c % 100, h the CRC-32 of
    its decimal id modulo 6, and goes on with its own turns after its first h. A donor has at most
    199 takers, so the lead turns are joined as one short list a donor.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % LEADS).cast("bigint")
    convs = turns.filter("place = 0").select("conv_id", "width", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % DONORS).alias("donor"))
    first = turns.filter(F.col("place") < LEADS - 1).filter(F.col("conv_id") % DONORS == 0)
    leads = first.groupBy(F.col("conv_id").alias("d")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "points"))).alias("lead"))
    lead = F.when(F.col("d").isNotNull() & (F.col("h") > 0), F.slice("lead", 1, F.greatest(F.col("h"), F.lit(1)).cast("int")))
    convs = stage(convs.join(leads, F.col("donor") == F.col("d"), "left").withColumn("lead", lead).withColumn("k", F.greatest(F.size("lead"), F.lit(0)).cast("bigint")), "rebuilt")
    taken = convs.select("conv_id", F.explode("lead").alias("t")).select("conv_id", "t.place", "t.digest", "t.points")
    shift = few(convs.select(F.col("conv_id").alias("c"), "h", "k"))
    own = turns.join(shift, F.col("conv_id") == F.col("c")).filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "digest", "points")
    return convs.select("conv_id", (F.col("k") + F.greatest(F.col("width") - F.col("h"), F.lit(0))).alias("length")), taken.unionByName(own)


LINKS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("points", pa.int64())])
LINKS_DDL = "conv_id long, segment long, depth long, digest binary, parent binary, points long"


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    rows.clear()
    return made


def rows_of(parts: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for part in parts:
        yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def chain(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests chained within each segment; its rows come in order, one after another."""
    rows: list[tuple] = []
    here, held = None, b""
    for conv, segment, place, turn, points in rows_of(parts, "conv_id", "segment", "place", "digest", "points"):
        if here != (conv, segment):
            here, held = (conv, segment), b""
        before, held = held, sha256(held + turn).digest()
        rows.append((conv, segment, place + 1, held, before, points))
        if len(rows) >= 5000:
            yield batch(rows, LINKS)
    if rows:
        yield batch(rows, LINKS)


STARTS = pa.schema([("c", pa.int64()), ("s", pa.int64()), ("start", pa.binary())])


def chain_segments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest that each segment but the first starts from: all before it, chained by segments."""
    rows: list[tuple] = []
    here, held = None, b""
    for conv, segment, last in rows_of(parts, "conv_id", "segment", "digest"):
        held = sha256(held + last).digest() if here == conv else last
        here = conv
        rows.append((conv, segment + 1, held))
        if len(rows) >= 5000:
            yield batch(rows, STARTS)
    if rows:
        yield batch(rows, STARTS)


def prefixes(convs: DataFrame, turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, depth, digest, parent (its digest) and points (of the last text) of every prefix, staged."""
    dealt = turns.withColumn("segment", F.expr(f"place div {segment}")).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")
    links = dealt.mapInArrow(chain, LINKS_DDL)
    if (convs.agg(F.max("length")).first()[0] or 0) > segment:
        links = stage(links, "links")
        lasts = links.filter(F.col("depth") == (F.col("segment") + 1) * segment).select("conv_id", "segment", "digest").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
        starts = few(stage(lasts.mapInArrow(chain_segments, "c long, s long, start binary"), "starts"))
        over = lambda d: F.unhex(F.sha2(F.concat("start", d), 256))
        later = links.filter("segment > 0").join(starts, (F.col("conv_id") == F.col("c")) & (F.col("segment") == F.col("s")))
        later = later.select("conv_id", "depth", over("digest").alias("digest"), F.when(F.octet_length("parent") == 0, F.col("start")).otherwise(over("parent")).alias("parent"), "points")
        links = links.filter("segment = 0").select("conv_id", "depth", "digest", "parent", "points").unionByName(later)
    roots = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(b"").alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("points"))
    return stage(links.select("conv_id", "depth", "digest", "parent", "points").unionByName(roots), "prefixes")


PIECES = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
ENDS = pa.schema([("e", pa.binary()), ("ends_sha256", pa.string())])


def join_ids(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node, joined in pieces."""
    rows: list[tuple] = []
    here, first, held, size = None, 0, [], 0
    for digest, conv in rows_of(parts, "digest", "conv_id"):
        if held and (here != digest or size > PIECE):
            rows.append((here, first, ",".join(held)))
            held, size = [], 0
            if len(rows) >= 100:
                yield batch(rows, PIECES)
        if not held:
            here, first = digest, conv
        held.append(str(conv))
        size += len(held[-1]) + 1
    if held:
        rows.append((here, first, ",".join(held)))
    if rows:
        yield batch(rows, PIECES)


def hash_ids(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in order."""
    rows: list[tuple] = []
    here, state = None, None
    for digest, ids in rows_of(parts, "digest", "ids"):
        if here != digest:
            if state:
                rows.append((here, state.hexdigest()))
            here, state = digest, sha256()
        else:
            state.update(b",")
        state.update(ids.encode())
        if len(rows) >= 5000:
            yield batch(rows, ENDS)
    if state:
        rows.append((here, state.hexdigest()))
    if rows:
        yield batch(rows, ENDS)


def end_digests(ends: DataFrame) -> DataFrame:
    """e (a node's digest) and ends_sha256 of nodes at which several conversations of ends (digest, conv_id; staged) end."""
    several = few(stage(ends.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("e")), "several"))
    shared = stage(ends.join(several, F.col("digest") == F.col("e"), "left_semi"), "ends")
    ranged = shared.repartitionByRange(partitions(ends.sparkSession), "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = stage(ranged.mapInArrow(join_ids, "digest binary, first long, ids string"), "pieces")
    return stage(pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hash_ids, "e binary, ends_sha256 string"), "hashed")


def trie(convs: DataFrame, turns: DataFrame, segment: int = SEGMENT, window: int = WINDOW) -> DataFrame:
    """One row a node of the trie of conversations (conv_id, length) with turns (conv_id, place, digest, points)."""
    every = prefixes(convs, turns, segment)
    length = few(convs.select(F.col("conv_id").alias("c"), "length"))
    marked = every.join(length, F.col("conv_id") == F.col("c")).withColumn("end", F.col("depth") == F.col("length"))
    ends = stage(marked.filter("end").select("digest", "conv_id"), "last")
    nodes = marked.groupBy("depth", "digest").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("points").alias("points"), F.count(F.when(F.col("end"), 1)).alias("n_ends"), F.min(F.when(F.col("end"), F.col("conv_id"))).alias("end")
    )
    nodes = stage(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("_d"), F.col("parent").alias("_p")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, (F.col("depth") == F.col("_d")) & (F.col("digest") == F.col("_p")), "left").drop("_d", "_p").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    nodes = stage(nodes, "nodes")

    above = every.select(F.col("conv_id").alias("of"), F.col("depth").alias("to"), F.col("digest").alias("at"))
    own = nodes.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"))

    def carried(values: DataFrame, span: int, itself: bool) -> DataFrame:
        same = (F.col("conv_id") == F.col("of")) & (F.expr(f"depth div {span}") == F.expr(f"to div {span}")) & (F.col("to") <= F.col("depth") if itself else F.col("to") < F.col("depth"))
        return values.join(above, same).groupBy("to", "at").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    sums = stage(carried(own, window, True), "sums")
    deepest, span = nodes.agg(F.max("depth")).first()[0] or 0, window
    while deepest >= span:
        tops = sums.filter((F.col("to") % span == 0) & (F.col("to") > 0)).join(nodes.select("conv_id", "depth", "digest"), (F.col("to") == F.col("depth")) & (F.col("at") == F.col("digest")))
        span *= window
        more = carried(tops.select("conv_id", "depth", "n_leaves", "saved_tokens"), span, False)
        sums = stage(sums.unionByName(more).groupBy("to", "at").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "sums")

    parents = few(nodes.filter("n_children > 0").select(F.col("depth").alias("_d"), F.col("digest").alias("_p"), F.col("conv_id").alias("parent_conv_id")))
    out = nodes.join(sums, (F.col("depth") == F.col("to")) & (F.col("digest") == F.col("at"))).join(parents, (F.col("depth") - 1 == F.col("_d")) & (F.col("parent") == F.col("_p")), "left")
    out = out.join(few(end_digests(ends)), F.col("digest") == F.col("e"), "left")
    sha = F.when(F.col("n_ends") == 0, F.sha2(F.lit(""), 256)).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string"), 256)).otherwise(F.col("ends_sha256"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"), "n_ends")


def conversation_trie(conversations: DataFrame, mixed: bool = False) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, turn, role, text), as they are or rebuilt from donors."""
    prepare(conversations.sparkSession)
    with scratch(conversations.sparkSession) as keep:
        turns = turns_of(conversations)
        return keep(trie(*(rebuilt if mixed else plain)(turns)), "trie")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), mixed=True)


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS width
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, any_value(width) AS width, conv_id - conv_id % 100 AS donor, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, w: xor(v // 2, (v % 2) * 3988292384 + w))) AS crc FROM t GROUP BY conv_id),
h AS (SELECT c.conv_id, c.donor, c.width, xor(c.crc, 4294967295) % 6 AS h, least(xor(c.crc, 4294967295) % 6, coalesce(d.width, 0)) AS k FROM c LEFT JOIN c d ON d.conv_id = c.donor),
r AS (SELECT h.conv_id, t.place AS pos, role, text FROM h JOIN t ON t.conv_id = h.donor AND t.place < h.h
  UNION ALL SELECT h.conv_id, k + t.place - h.h, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.place >= h.h),
p AS (SELECT conv_id, pos + 1 AS depth, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '' ) OVER (PARTITION BY conv_id ORDER BY pos)) AS name, length(text) AS points FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
n AS (SELECT depth, name, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points, coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (depth = len), '') AS ids, count(*) FILTER (depth = len) AS n_ends FROM p JOIN l ON p.conv_id = l.conv_id GROUP BY depth, name),
o AS (SELECT n.*, q.name AS up FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
k AS (SELECT depth - 1 AS depth, up AS name, count(*) AS n_children FROM o WHERE depth > 0 GROUP BY ALL),
v AS (SELECT o.*, coalesce(n_children, 0) AS n_children FROM o LEFT JOIN k ON o.depth = k.depth AND o.name = k.name),
s AS (SELECT p.depth, p.name, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * v.points)::BIGINT AS saved_tokens FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.depth, p.name)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, sha256(v.ids) AS ends_sha256, v.n_ends
FROM v JOIN s ON v.depth = s.depth AND v.name = s.name LEFT JOIN n u ON u.depth = v.depth - 1 AND u.name = v.up
"""
