"""Mixing sources to target weights by the cube method.

Sizes are word counts. Sources in code point order weigh 3, 1, 2, repeating; their shares
of 150% of all words are capped at twice the source's words and the excess is shared
again, solved in closed form over the sources in order of cap per weight. A document is
taken floor(target / size) times, and once more with the fractional part as inclusion
probability. The cube method moves these probabilities within blocks of a source along
directions that keep both its token and its document total, until at most two of a block
are undecided; these meet in further rounds of blocks, and the last few of a source are
settled so that its words come nearest to the target. Blocks are bounded whatever the
size of a source, and every draw is seeded by the block, so reruns agree.

Results for edge cases: a null or wordless text has size 0 and is taken 0 times; a null
source is a source, the last one; rows that repeat id, source and text are drawn one by
one; a very long text is one document whose size may be far from the others'; documents
of equal size are exchanged for each other; an empty table gives no rows; other columns,
whatever their names, are kept by mix and not read here.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.staging import few, scratch, stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK = 2048
FAN = 512  # blocks whose undecided documents meet in the next round
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def flight(sizes: list[float], p: list[float], rng: random.Random) -> list[float]:
    """Move p in the null-space of (1, size) until fewer than three lie strictly inside (0, 1).

    Three undecided documents always have such a direction: the cross product of the
    two constraint rows, or an exchange of two where all three sizes are equal.
    """
    p = list(p)
    inside: list[int] = []
    rest = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    rest.reverse()
    while True:
        while len(inside) < 3 and rest:
            inside.append(rest.pop())
        if len(inside) < 3:
            break
        a, b, c = inside
        u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(inside, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(inside, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(inside, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
        inside = [i for i in inside if EPS < p[i] < 1 - EPS]
    # two of equal size can still exchange
    if len(inside) == 2 and sizes[inside[0]] == sizes[inside[1]]:
        a, b = inside
        whole = p[a] + p[b]
        first = rng.random() * whole < p[a]
        p[a], p[b] = (min(1.0, whole), max(0.0, whole - 1)) if first else (max(0.0, whole - 1), min(1.0, whole))
    return [0.0 if x <= EPS else 1.0 if x >= 1 - EPS else x for x in p]


def landing(sizes: list[float], p: list[float]) -> list[float]:
    """Settle the few undecided: of all outcomes that whose words come nearest to the expected."""
    left = [i for i in range(len(p)) if 0 < p[i] < 1]
    want = sum(p[i] * sizes[i] for i in left)
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(sizes[i] for k, i in enumerate(left) if m >> k & 1) - want), m))
    out = list(p)
    for k, i in enumerate(left):
        out[i] = float(best >> k & 1)
    return out


def settle(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "doc_id", "th", "occ"], kind="stable")
        first = pdf.iloc[0]
        rng = random.Random(f"{first['source']}|{first['block']}|{len(pdf)}")
        sizes = [float(x) for x in pdf["size"]]
        p = flight(sizes, pdf["p"].tolist(), rng)
        pdf["p"] = landing(sizes, p) if last else p
        return pdf

    return run


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of each source. sizes: source, size. One row a source is ordered."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", (F.lit(CAP) * F.col("source_size")).cast("double")).withColumn("key", F.col("cap") / F.col("w"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("key", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    here = everything.orderBy("key", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    want = F.lit(SHARE) * F.sum("source_size").over(everything)
    level = (want - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(here)
    per = per.withColumn("level", level).withColumn("full", F.col("key") <= F.col("level"))
    common = F.min(F.when(~F.col("full"), F.struct("key", "level"))).over(everything)["level"]
    return per.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(common * F.col("w"))).select("source", "source_size", "target")


def decide(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, source, th, size, source_size, target, copies; staged."""
    with scratch(docs.sparkSession) as keep:
        return keep(_decide(docs.select("doc_id", "source", F.xxhash64("text").alias("th"), size_of("text").alias("size"))), "decided")


def size_of(column: str) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("bigint")


def _decide(rows: DataFrame) -> DataFrame:
    """rows: doc_id, source, th (equal for rows that count as repeats), size."""
    units = stage(rows.groupBy("doc_id", "source", "th", "size").agg(F.count("*").alias("m")), "units")
    goal = stage(targets(units.select("source", (F.col("size") * F.col("m")).alias("size"))), "targets")
    each = units.withColumn("occ", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).drop("m")
    each = each.join(few(goal).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = each.withColumn("base", F.least(F.floor(ratio + EPS), F.lit(CAP)).cast("int")).withColumn("p", F.greatest(F.lit(0.0), ratio - F.col("base")))
    each = each.withColumn("p", F.when((F.col("size") == 0) | (F.col("p") < EPS), 0.0).otherwise(F.col("p"))).withColumn("r", F.xxhash64("doc_id", "th", "occ"))
    counts = stage(each.filter("p > 0").groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "counts")
    blocks = counts.agg(F.max("blocks")).first()[0] or 0
    todo = each.filter("p > 0").join(few(counts).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    todo = todo.withColumn("block", F.pmod(F.col("r"), F.col("blocks")).cast("int")).drop("blocks")
    settled = each.filter("p = 0").withColumn("block", F.lit(0))
    while blocks:
        last = blocks == 1
        moved = stage(todo.groupBy("source", "block").applyInPandas(settle(last), todo.schema), "cube")
        settled = settled.unionByName(moved if last else moved.filter("p = 0 or p = 1"))
        todo = moved.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / FAN).cast("int"))
        blocks = 0 if last else -(-blocks // FAN)
    copies = F.col("base") + F.round("p").cast("int")
    return settled.select("doc_id", "source", "th", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row appears as often as it is taken, with all its columns.

    What is taken is decided on light rows, named by id and a hash of all columns; whole
    rows are dealt once, by that name. Rows that are equal in all columns stand for each other: of
    these, one is dealt for each task and copied. An empty table stays empty.
    """
    spark = docs.sparkSession
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # what can be hashed
    name = F.xxhash64(*[x for c in plain for x in (c.isNull(), c)])
    with scratch(spark) as keep:
        light = docs.select(F.col("doc_id"), F.col("source"), name.alias("th"), size_of("text").alias("size"))
        got = _decide(light).groupBy(F.coalesce("doc_id", F.lit(0)).alias("id"), "th").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
        got = keep(got.filter("copies > 0"), "taken")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(0)).alias("doc"), name.alias("name"))  # columns of any name cannot clash inside
    same = (F.col("doc") == F.col("id")) & (F.col("name") == F.col("th"))
    again = F.explode(F.sequence(F.lit(1), F.col("copies")))
    single, many = got.filter("rows = 1").drop("rows"), got.filter("rows > 1").drop("rows")
    out = whole.join(single, same).select("row", again)
    if not many.isEmpty():
        own = whole.join(few(many.select("id", "th")), same, "left_semi").groupBy("doc", "name").agg(F.first("row").alias("row"))
        out = out.unionByName(own.join(few(many), same).select("row", again))
    return out.select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), "source")
