"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into segments, and each is described by its mean and deviation. For
segments of m components, sum m * ((mq - mx)^2 + (sq - sx)^2) is a lower bound of the
squared distance, hence (|q|^2 + |x|^2 - bound) / 2 an upper bound of the inner product.
Each task keeps the k best of every query; a candidate whose coarse bound, then finer
bound, stays below a query's k-th score is dropped, and the survivors get exact integer
products. Queries are packed into blocks of bounded size; one block at a time is broadcast,
searched for, and written with its k best before the next, so that the driver and a worker
hold one block, and bounds for a tile of it. The work is queries against candidates, with
nothing shuffled but k rows a task and query.

Results for edge cases: vectors that are null, hold null, NaN or infinite components, or
have no vec_id take no part; vectors of another length than the query's are no
candidates; of a repeated query id the smallest vector asks; repeated candidate rows are
each ranked; ties go to the smaller vec_id; very long vectors are searched whole; an empty
table gives no rows; other columns, whatever their names, are not read. Components saturate
at 2**62 and scores wrap as 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.staging import scratch, setting, stage
from graphloom.session import ship

SCALE = 1024
K = 10
QUERY_EVERY = 100
BLOCK_BYTES = 16 << 20  # of queries that are broadcast at once
TILE = 256  # queries whose bounds a worker holds at once
SEGMENTS = (4, 16)  # coarse, then fine
ROWS = "query_id long, vec_id long, score long"


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantise(arrays: list[np.ndarray], scale: int) -> np.ndarray:
    x = np.floor(scale * np.stack(arrays).astype(np.float64))
    return np.clip(x, -(2.0**62), 2.0**62).astype(np.int64)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length."""
    cut = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    m = np.diff(cut).astype(float)
    mean = np.add.reduceat(x, cut[:-1], axis=1) / m
    spread = x - np.repeat(mean, m.astype(int), axis=1)  # not E[x^2] - mean^2, which cancels
    dev = np.sqrt(np.add.reduceat(spread * spread, cut[:-1], axis=1) / m)
    return np.concatenate((mean * np.sqrt(m), dev * np.sqrt(m)), axis=1)


class Best:
    """The k best of each query so far, best first."""

    def __init__(self, queries: int, k: int):
        self.score = np.zeros((queries, k), np.int64)
        self.ids = np.zeros((queries, k), np.int64)
        self.n = np.zeros(queries, int)
        self.k = k

    def floor(self, q: int) -> float:
        return float(self.score[q, self.k - 1]) if self.n[q] == self.k else -np.inf

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        n = self.n[q]
        s, i = np.concatenate((self.score[q, :n], score)), np.concatenate((self.ids[q, :n], ids))
        order = np.lexsort((i, ~s))[: self.k]  # ~s reverses the order without overflow
        self.n[q] = len(order)
        self.score[q, : len(order)], self.ids[q, : len(order)] = s[order], i[order]


def search_block(best: Best, qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
    """Update best with the candidates x; q and x are integer vectors of one length."""
    d = x.shape[1]
    if not d or float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * d >= 2.0**52:
        for i in range(len(qid)):  # bounds would lose digits: exact products for all
            keep = ids != qid[i]
            best.add(i, x[keep] @ q[i], ids[keep])
        return
    xf = x.astype(float)
    xs = [statistics(xf, s) for s in SEGMENTS]
    longest = float(np.sqrt((xf * xf).sum(1)).max(initial=0))
    for at in range(0, len(qid), TILE):
        search_tile(best, at, qid[at : at + TILE], q[at : at + TILE], ids, x, xs, longest)


def search_tile(best: Best, first: int, qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, xs: list[np.ndarray], longest: float) -> None:
    """The same for a tile of queries, the first of which has that number. xs: statistics of x; longest: of the norms of x."""
    qf = q.astype(float)
    qs = [statistics(qf, s) for s in SEGMENTS]
    slack = 1e-9 * np.sqrt((qf * qf).sum(1)) * longest + 1e-6
    coarse = qs[0] @ xs[0].T + slack[:, None]  # (|q|^2 + |x|^2 - lower bound of the distance) / 2
    k = best.k
    for i in range(len(qid)):
        bound, number = coarse[i], first + i
        bound[ids == qid[i]] = -np.inf
        floor = best.floor(number)
        if floor == -np.inf:  # the best-looking candidates give a first floor
            head = np.argpartition(-bound, min(2 * k, len(bound)) - 1)[: 2 * k]
            head = head[bound[head] > -np.inf]
            best.add(number, x[head] @ q[i], ids[head])
            bound[head] = -np.inf
            floor = best.floor(number)
        left = np.flatnonzero(bound >= floor) if floor > -np.inf else np.flatnonzero(bound > -np.inf)
        if len(left):
            left = left[xs[1][left] @ qs[1][i] + slack[i] >= floor]
        if len(left):
            score = x[left] @ q[i]
            keep = score >= floor
            best.add(number, score[keep], ids[left][keep])


def scanner(queries, k: int, scale: int):
    """Candidates of a partition against the broadcast queries: {length: (ids, vectors)}."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = queries.value
        best = {d: Best(len(ids), k) for d, (ids, _) in blocks.items()}
        for part in parts:
            lengths = part["embedding"].map(len).to_numpy() if len(part) else np.zeros(0, int)
            for d in np.unique(lengths):
                if int(d) in blocks:
                    own = np.flatnonzero(lengths == d)
                    x = quantise(list(part["embedding"].to_numpy()[own]), scale)
                    search_block(best[int(d)], *blocks[int(d)], part["vec_id"].to_numpy()[own], x)
        for d, (ids, _) in blocks.items():
            b = best[d]
            for at in range(0, len(ids), TILE):
                n = b.n[at : at + TILE]
                taken = np.arange(k) < n[:, None]
                yield pd.DataFrame({"query_id": np.repeat(ids[at : at + TILE], n), "vec_id": b.ids[at : at + TILE][taken], "score": b.score[at : at + TILE][taken]})

    return run


def pack_block(rows: pd.DataFrame, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (ids, integer vectors)} of queries."""
    by = {}
    for d, part in rows.groupby(rows["embedding"].map(len) if len(rows) else pd.Series([], dtype=int)):
        by[int(d)] = (part["vec_id"].to_numpy(np.int64), quantise(list(part["embedding"]), scale).reshape(len(part), int(d)))
    return by


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score; staged. Both inputs have vec_id and embedding."""
    spark = candidates.sparkSession
    ship(spark)
    pick = lambda df: df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    with scratch(spark) as keep, setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "4096"), setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)):
        asked = stage(pick(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
        size = asked.agg(F.sum(F.size("embedding") * 8 + 64)).first()[0] or 0
        blocks = max(1, -(-size * 5 // (4 * block_bytes)))
        found = None
        for b in range(blocks):
            own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
            shared = spark.sparkContext.broadcast(pack_block(own.toPandas(), scale))  # about block_bytes
            rows = pick(candidates).mapInPandas(scanner(shared, k, scale), ROWS)
            ranked = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            part = keep(ranked, "best")
            shared.destroy()
            found = part if found is None else found.unionByName(part)
    return found


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(v.filter(F.col("vec_id") % QUERY_EVERY == 0), v)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""
