"""Shared plumbing: staged tables in the cluster's shared folder, even dealing of small keys."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import CLEANUP, setting, shared_dir, ship

#: Rows that reach a Python worker at once; whole texts can be long, so batches are small.
BATCH_ROWS = "2000"


#: Rows of at most a few numbers that a join may broadcast, about 100 MB as a hash table; beyond it the join shuffles.
BROADCAST_ROWS = 1 << 22
#: Open scopes of this thread (or task of asyncio), the innermost last; other threads have their own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
#: Files that a table staged here has at most, where the tables are known to be small.
_files: ContextVar[int | None] = ContextVar("files", default=None)
#: Tables that no scope removes: results that were returned to the caller.
_kept: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Settings and sources that the operators' Python workers need."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to a table of the shared folder and read it back.

    The lineage ends here: a lost executor repeats nothing before it, and Spark's
    committer lets a repeated task replace its own output only. Within scratch() the
    table goes at the end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}"
    (_scopes.get() or (_kept,))[-1].append(path)
    if most := _files.get():
        df = df.coalesce(most)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with setting(spark, CLEANUP, "true"):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Tables staged inside are deleted at the end, but for those staged by the function given.

    What is returned from inside may read tables of that function only; they belong to the
    scope around this one, or, where there is none, stay until release().
    """
    own: list[str] = []
    around = _scopes.get()

    def keep(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        inside = _scopes.set(around)
        try:
            return stage(df, name, partition_by)
        finally:
            _scopes.reset(inside)

    outside = _scopes.set((*around, own))
    try:
        yield keep
    finally:
        _scopes.reset(outside)
        for path in own:
            remove(spark, path)


@contextmanager
def lean(rows: int, each: int = 4096, least: int = 8) -> Iterator[None]:
    """Tables staged inside, known to grow with so many rows, get a file for each `each` of them, and at least `least`.

    Many steps on small tables then spend their time on rows and not on tasks; large tables have
    as many files as without.
    """
    before = _files.set(max(least, -(-rows // each)))
    try:
        yield
    finally:
        _files.reset(before)


def release(spark: SparkSession) -> int:
    """Delete every table that a result reads and no scope removes; how many there were."""
    n = 0
    while _kept:
        remove(spark, _kept.pop())
        n += 1
    return n


def few(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of short rows, to be broadcast by a join if it has at most so many rows."""
    return F.broadcast(table) if table.count() <= rows else table


def give_back() -> None:
    """Free memory of this process goes back to the machine, where the allocator can do so."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker, kept for later tasks, holds no free memory."""

    def tidied(parts: Iterator) -> Iterator:
        try:
            yield from run(parts)
        finally:
            give_back()

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _murmur(value: int, seed: int = 42) -> int:
    """Spark's 32-bit hash of an int column."""
    m = 0xFFFFFFFF
    k = (value & m) * 0xCC9E2D51 & m
    k = ((k << 15) | (k >> 17)) & m
    h = seed ^ (k * 0x1B873593 & m)
    h = ((h << 13) | (h >> 19)) & m
    h = (h * 5 + 0xE6546B64) & m
    h ^= 4
    for shift, mul in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> shift)) * mul) & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def even_keys(n: int) -> list[int]:
    """n ints, the i-th of which repartition(n, key) sends to partition i."""
    found: dict[int, int] = {}
    k = 0
    while len(found) < n:
        found.setdefault(_murmur(k) % n, k)
        k += 1
    return [found[i] for i in range(n)]


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0
