"""Merkle manifest of a dataset: a digest for each row, a root a source, one root of all, a proof a row.

Rows are leaves, in the order of their keys within a source; every ARITY consecutive nodes of a
level become their parent, the last run may be shorter, until one node is left, the
subroot. Subroots in the order of their sources make a tree of the same kind.

Building is event-driven. A leaf knows its place and the width of its level, and so the
place of its parent and how many children that has. Tasks hold partial parents; a child that
arrives is put at its index, the child that completes a parent makes its digest, and the parent
goes on as an event to its own parent. What is still partial when a task's rows end is its
frontier: these children are dealt again, by the ancestor BAND levels up, until none is left.
As leaves come in order, a task's frontier is a few nodes a level.

Every parent that is made keeps its children's digests in order: the reverse links. Paths go down
along them, band by band, from the root: a child's path is its siblings to the left and right,
then its parent's path. At a leaf the path is the proof. A group holds one ancestor's
descendants of BAND levels, at most 3 ** BAND leaves, whatever the size of a source.

Results for edge cases: null values count as `-`; a null source is a source, the first one; a
null key comes first and is never tampered with; rows with equal keys of a source are ordered by
their digests, so reruns agree, and equal rows are each returned; a lone leaf is its subroot and a
lone subroot the root, with empty proofs where there are no siblings; very long texts are
hashed whole in one pass by the engine, empty ones like others; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.places import numbered
from graphloom.llm.staging import prepare, scratch, stage

ARITY = 3
#: Levels that a round of building, or of paths, takes at once; 3 ** 7 = 2187 leaves a group.
BAND = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
CHILD, PARENT, TOP = 0, 1, 2


def field_of(value: Column) -> Column:
    """`-` for null, else the value's bytes of UTF-8 counted, and the value."""
    plain = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain))


def leaf_of(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field_of, values)), 256))


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """rows, taken out of their list, as a batch."""
    made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    rows.clear()
    return made


def digest_of(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


# --- building ---

NODES = pa.schema([("kind", pa.int32()), ("source", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("width", pa.int64()), ("digest", pa.binary()), ("children", pa.list_(pa.binary()))])
NODES_DDL = "kind int, source string, level int, place long, width long, digest binary, children array<binary>"
Child = tuple[int, int, str]  # index, place, digest


def accumulate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents that the task's children complete (PARENT), trees that end (TOP), and the frontier (CHILD)."""
    partial: dict[tuple[str | None, int, int], tuple[int, list[Child]]] = {}
    rows: list[tuple] = []

    def arrive(source: str | None, level: int, place: int, width: int, digest: str) -> None:
        while width > 1:
            above, index = divmod(place, ARITY)
            key = (source, level, above)
            _, held = partial.setdefault(key, (width, []))
            held.append((index, place, digest))
            if len(held) < min(ARITY, width - ARITY * above):
                return
            del partial[key]
            children = [d for _, _, d in sorted(held)]
            level, place, width, digest = level + 1, above, -(-width // ARITY), digest_of(children)
            rows.append((PARENT, source, level, place, width, bytes.fromhex(digest), [bytes.fromhex(d) for d in children]))
        rows.append((TOP, source, level, place, width, bytes.fromhex(digest), None))

    for part in parts:
        for source, level, place, width, digest in zip(*[part.column(c).to_pylist() for c in ("source", "level", "place", "width", "digest")], strict=True):
            arrive(source, level, place, width, digest.hex())
            if len(rows) >= 5000:
                yield batch(rows, NODES)
        if rows:
            yield batch(rows, NODES)
    for (source, level, _), (width, held) in partial.items():
        rows += [(CHILD, source, level, place, width, bytes.fromhex(d), None) for _, place, d in held]
        if len(rows) >= 5000:
            yield batch(rows, NODES)
    if rows:
        yield batch(rows, NODES)


def ancestor(at: int) -> Column:
    """Place of a node's ancestor at a level that is at most BAND above its own."""
    return F.expr(f"place div element_at(array({', '.join(f'{ARITY**i}L' for i in range(BAND + 1))}), {at} - level + 1)")


def build(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """parents and tops of the trees whose leaves (source, place, width, digest) are given."""
    made = [stage(leaves.select("source", F.lit(0).alias("level"), "place", "width", "digest").mapInArrow(accumulate, NODES_DDL), name, "kind")]
    frontier, at = made[0].filter(f"kind = {CHILD}"), BAND
    while not frontier.isEmpty():
        due = frontier.filter(F.col("level") < at)
        rest = frontier.filter(F.col("level") >= at)
        dealt = due.repartition("source", ancestor(at))
        done = stage(dealt.select("source", "level", "place", "width", "digest").mapInArrow(accumulate, NODES_DDL), name, "kind")
        made.append(done)
        frontier, at = rest.unionByName(done.filter(f"kind = {CHILD}")), at + BAND
    nodes = made[0]
    for more in made[1:]:
        nodes = nodes.unionByName(more)
    return nodes.filter(f"kind = {PARENT}"), nodes.filter(f"kind = {TOP}")


# --- proofs ---

PATHS = pa.schema([("source", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("path", pa.string()), ("subroot", pa.string()), ("root", pa.string())])
PATHS_DDL = "source string, level int, place long, path string, subroot string, root string"
SEED, LINKS, LEAF = 0, 1, 2
Given = tuple[str, str, str]  # path, subroot, root


def blocks(parts: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for part in parts:
        yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def steps_of(children: list[bytes]) -> Iterator[str]:
    """For each child its siblings, as `left|right;`."""
    names = [c.hex() for c in children]
    for i in range(len(names)):
        yield "".join(names[:i]) + "|" + "".join(names[i + 1 :]) + ";"


def push(floor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Paths of the nodes at level floor; rows come block by block, each from the top down."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for source, level, place, given in descend(blocks(parts, ["source", "block", "kind", "level", "place", "path", "subroot", "root", "children"]), floor):
            rows.append((source, level, place, *given))
            if len(rows) >= 2000:
                yield batch(rows, PATHS)
        if rows:
            yield batch(rows, PATHS)

    return run


def descend(rows: Iterator[tuple], floor: int, leaf: Callable | None = None) -> Iterator[tuple]:
    """(source, level, place, given) of nodes at the floor, or leaf(row, given) of the leaves among the rows."""
    known: dict[tuple[int, int], Given] = {}
    here: tuple | None = None
    for source, block, kind, level, place, path, subroot, root, children, *more in rows:
        if here != (source, block):
            here, known = (source, block), {}
        if kind == SEED:
            known[level, place] = (path, subroot, root)
            if leaf is None and level == floor:
                yield source, level, place, known.pop((level, place))
        elif kind == LINKS:
            above = known.pop((level, place))
            for i, step in enumerate(steps_of(children)):
                given = (step + above[0], *above[1:])
                if leaf is None and level - 1 == floor:
                    yield source, floor, place * ARITY + i, given
                else:
                    known[level - 1, place * ARITY + i] = given
        else:
            yield leaf(more, known.pop((0, place)))


def fold(digest: str, path: str) -> str:
    """The root that a leaf's digest and its path give."""
    for step in path.split(";")[:-1]:
        left, right = step.split("|")
        digest = digest_of([left, digest, right])
    return digest


def proof_of(path: str) -> str:
    """Siblings level by level, left to right."""
    return path.replace("|", "").replace(";", "")


PROVED = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("source", pa.string()), ("proof_digests", pa.int32())])
PROVED_DDL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string, proof_digests int"


def prove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result rows of the leaves; every row's root is folded from its own proof."""

    def one(more: list, given: Given) -> tuple:
        (source, doc_id, leaf, tampered), (path, subroot, root) = more, given
        proof = proof_of(path)
        folded = fold((tampered or leaf).hex(), path)
        return doc_id, leaf.hex(), subroot, root, sha256(proof.encode()).hexdigest(), folded, folded == root, source, len(proof) // 64

    rows: list[tuple] = []
    named = ["source", "block", "kind", "level", "place", "path", "subroot", "root", "children", "source", "doc_id", "leaf", "tampered"]
    for row in descend(blocks(parts, named), 0, one):
        rows.append(row)
        if len(rows) >= 5000:
            yield batch(rows, PROVED)
    if rows:
        yield batch(rows, PROVED)


def _banded(table: DataFrame, kind: int, top: int) -> DataFrame:
    """Rows of a band that ends at level top, with the place of their ancestor there."""
    none = {"path": "string", "subroot": "string", "root": "string", "children": "array<binary>", "doc_id": "bigint", "leaf": "binary", "tampered": "binary"}
    known = set(table.columns)
    return table.select("source", ancestor(top).alias("block"), F.lit(kind).alias("kind"), "level", "place", *[F.col(c) if c in known else F.lit(None).cast(t).alias(c) for c, t in none.items()])


def paths(parents: DataFrame, seeds: DataFrame, name: str, leaves: DataFrame | None = None) -> DataFrame:
    """Paths (source, level 0, place, path, subroot, root) of all leaves below the seeds.

    seeds: the same columns, one row a tree at its top. With leaves (source, place, doc_id,
    leaf, tampered) they are proved where their paths end, and their result rows returned.
    """
    highest = seeds.agg(F.max("level")).first()[0] or 0
    floor = max(0, -(-highest // BAND) - 1) * BAND
    above = None
    while True:
        top = floor + BAND
        own = seeds.filter((F.col("level") > floor) & (F.col("level") <= top) | (F.col("level") == 0) & F.lit(floor == 0))
        rows = _banded(own if above is None else own.unionByName(above), SEED, top)
        rows = rows.unionByName(_banded(parents.filter((F.col("level") > floor) & (F.col("level") <= top)), LINKS, top))
        if floor == 0 and leaves is not None:
            rows = rows.unionByName(_banded(leaves.withColumn("level", F.lit(0)), LEAF, top))
        dealt = rows.repartition("source", "block").sortWithinPartitions("source", "block", F.desc("level"), "kind")
        if floor == 0:
            return dealt.mapInArrow(prove, PROVED_DDL) if leaves is not None else dealt.mapInArrow(push(0), PATHS_DDL)
        above = stage(dealt.mapInArrow(push(floor), PATHS_DDL), name)
        floor -= BAND


def manifest(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every row of docs (doc_id, source, lang, n_chars, text).

    tamper says which rows' texts lose their line ends before their root is folded again.
    """
    spark = docs.sparkSession
    prepare(spark)
    given = docs.select(*[F.col(c) for c in FIELDS])
    changed = [F.col(c) for c in FIELDS[:-1]] + [F.replace(F.col("text"), F.lit("\n"), F.lit(""))]
    wanted = F.coalesce(tamper if tamper is not None else F.lit(False), F.lit(False)) & F.col("text").contains("\n")
    with scratch(spark) as keep:
        light = given.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_of([F.col(c) for c in FIELDS]).alias("leaf"), F.when(wanted, leaf_of(changed)).alias("tampered"))
        leaves = numbered(stage(light, "leaves"), ["source"], ["doc_id", "leaf"], "ordered")
        parents, tops = build(leaves.withColumnRenamed("leaf", "digest"), "nodes")
        subroots = numbered(stage(tops.select("source", "level", "digest"), "subroots"), [], ["source"], "sources")
        joined, crown = build(subroots.select(F.lit(None).cast("string").alias("source"), "place", "width", "digest"), "crown")
        root = F.lower(F.hex("digest"))
        start = crown.select("source", "level", "place", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), root.alias("root"))
        ends = stage(paths(joined, start, "upper").select(F.col("place").alias("_at"), "path", "root"), "ends")
        seeds = subroots.join(ends, F.col("place") == F.col("_at")).select("source", "level", F.lit(0).cast("bigint").alias("place"), "path", F.lower(F.hex("digest")).alias("subroot"), "root")
        return keep(paths(parents, stage(seeds, "seeds"), "lower", leaves.select("source", "place", "doc_id", "leaf", "tampered")), "manifest")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 2 == 0)


ORACLE = r"""
WITH RECURSIVE c AS (SELECT DISTINCT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, w: xor(v // 2, (v % 2) * 3988292384 + w))) AS crc FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT doc_id, source, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
  || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head, text, replace(text, chr(10), '') AS cut FROM documents),
h AS (SELECT d.doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(octet_length(encode(cut)) || ':' || cut, '-')) END AS tampered FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS width FROM h),
nodes AS (SELECT 0 AS level, source, place, width, leaf AS digest FROM l
  UNION ALL SELECT level + 1, source, place // 3, (any_value(width) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE width > 1 GROUP BY level, source, place // 3),
tops AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS width FROM nodes WHERE width = 1),
crown AS (SELECT 0 AS level, place, width, subroot AS digest FROM tops
  UNION ALL SELECT level + 1, place // 3, (any_value(width) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM crown WHERE width > 1 GROUP BY level, place // 3),
steps AS (SELECT n.level, n.source, n.place, string_agg(o.digest, '' ORDER BY o.place) FILTER (o.place < n.place) AS l, string_agg(o.digest, '' ORDER BY o.place) FILTER (o.place > n.place) AS r
  FROM nodes n JOIN nodes o ON n.level = o.level AND n.source IS NOT DISTINCT FROM o.source AND n.place // 3 = o.place // 3 WHERE n.width > 1 GROUP BY ALL),
upper AS (SELECT n.level, n.place, string_agg(o.digest, '' ORDER BY o.place) FILTER (o.place < n.place) AS l, string_agg(o.digest, '' ORDER BY o.place) FILTER (o.place > n.place) AS r
  FROM crown n JOIN crown o ON n.level = o.level AND n.place // 3 = o.place // 3 WHERE n.width > 1 GROUP BY ALL),
walk AS (SELECT l.source, l.place AS leaf_place, doc_id, leaf, coalesce(tampered, leaf) AS folded, '' AS proof, 0 AS level, l.place, l.width, false AS above FROM l
  UNION ALL SELECT w.source, leaf_place, doc_id, leaf, CASE WHEN NOT above AND w.width = 1 THEN folded ELSE sha256(coalesce(s.l, u.l, '') || folded || coalesce(s.r, u.r, '')) END, proof || coalesce(s.l, u.l, '') || coalesce(s.r, u.r, ''),
    CASE WHEN NOT above AND w.width = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN NOT above AND w.width = 1 THEN t.place ELSE w.place // 3 END, CASE WHEN NOT above AND w.width = 1 THEN t.width ELSE (w.width + 2) // 3 END, above OR w.width = 1
  FROM walk w JOIN tops t ON w.source IS NOT DISTINCT FROM t.source LEFT JOIN steps s ON NOT above AND s.level = w.level AND s.source IS NOT DISTINCT FROM w.source AND s.place = w.place
  LEFT JOIN upper u ON above AND u.level = w.level AND u.place = w.place WHERE NOT above OR w.width > 1)
SELECT w.doc_id, leaf, t.subroot, (SELECT digest FROM crown WHERE width = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT digest FROM crown WHERE width = 1) AS verified, w.source, (length(proof) // 64)::INTEGER AS proof_digests
FROM walk w JOIN tops t ON w.source IS NOT DISTINCT FROM t.source WHERE above AND w.width = 1
"""
