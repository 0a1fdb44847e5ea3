"""Repository scan: listing, limits, exclusion, file contents.

A repository on a mount is listed and read by tasks: a data source with a partition for each
of its folders near the top walks what is below. One on any other file system that the engine
reads is listed through that file system and read by the engine's reader of binary files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.config import ExtractorConfig
from graphloom.functions.scalar import EXTENSION_LANGUAGE, excluded, language_of
from graphloom.session import ship, work_path
from graphloom.sources.snapshots import Folder

MB = 1024 * 1024


def extensions(language: str) -> list[str]:
    """Suffixes of a language; C headers are shared by C and C++."""
    own = [e for e, lang in EXTENSION_LANGUAGE.items() if lang == language]
    return own + [".h"] if language == "c" else own


def is_inside(path: Path, root: Path) -> bool:
    """Whether the path, symlinks followed, lies in the root; both are resolved."""
    try:
        return path.resolve(strict=True).is_relative_to(root.resolve())
    except OSError:  # a broken link
        return False


class Walk(InputPartition):
    """A folder, with what is below it if deep."""

    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


class SourceTree(DataSource):
    """Rows path, rel, length, real of the files of a mounted folder; files that links lead out of it are left out."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, rel string, length long, real string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TreeReader(self.options["path"], set(self.options["suffixes"].split(",")), int(self.options.get("folders", 64)))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, suffixes: set[str], folders: int):
        self.root, self.suffixes, self.folders = root, suffixes, folders

    def partitions(self) -> list[Walk]:
        """Folders from the top, broadest first, until there are enough to share out."""
        shallow, deep = [], [self.root]
        while deep and len(shallow) + len(deep) < self.folders:
            below = [e.path for d in deep for e in sorted(os.scandir(d), key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]
            shallow += deep
            deep = below
        return [Walk(d, False) for d in shallow] + [Walk(d, True) for d in deep]

    def read(self, partition: Walk) -> Iterator[tuple]:
        base = Path(self.root)
        for folder, dirs, names in os.walk(partition.folder):
            if not partition.deep:
                dirs.clear()
            for name in names:
                p = Path(folder, name)
                if p.suffix in self.suffixes and is_inside(p, base):
                    real = p.resolve()
                    yield str(p), str(p.relative_to(base)), real.stat().st_size, str(real)


def is_mounted(root: str) -> bool:
    """Whether a path is named without a file system, and so is one of each machine."""
    return "://" not in root and not root.startswith("file:")


def list_files(spark: SparkSession, root: str, config: ExtractorConfig) -> DataFrame:
    """path, rel, length, lang of the source files to extract.

    Files outside the root, of other languages, excluded or over the size limit are
    left out. Too many files or bytes raise ValueError.
    """
    wanted = sorted({e for lang in config.languages for e in extensions(lang)})
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    if is_mounted(root):
        base = Path(root).resolve()
        if not base.is_dir():
            raise ValueError(f"Not a directory: {root}")
        ship(spark)
        spark.dataSource.register(SourceTree)
        found = spark.read.format("source_tree").option("suffixes", ",".join(wanted)).load(str(base))
        files = found.groupBy("real").agg(F.min(F.struct("path", "rel", "length")).alias("x")).select("x.*")  # links to one file are one
    else:
        folder, cap = Folder(spark, root), config.max_repo_size_mb * MB
        if not folder.is_folder():
            raise ValueError(f"Not a directory: {root}")
        rows, size = [], 0
        for rel, length in folder.files():
            if os.path.splitext(rel)[1] in wanted:
                rows.append((f"{folder.path}/{rel}", rel, length))
                size += length
                if size > cap:  # before all is listed
                    raise ValueError(f"Repository is larger than {config.max_repo_size_mb} MB")
        files = spark.createDataFrame(rows, "path string, rel string, length bigint")
    path = work_path(spark, "listing")
    files.write.parquet(path)  # walked once
    files = spark.read.schema(files.schema).parquet(path)
    if (files.agg(F.sum("length")).first()[0] or 0) > config.max_repo_size_mb * MB:
        raise ValueError(f"Repository is larger than {config.max_repo_size_mb} MB")
    kept = files.withColumn("lang", language_of("path")).filter(
        F.col("lang").isin(*config.languages) & ~excluded("rel", config.exclude) & (F.col("length") <= config.max_file_size_mb * MB)
    )
    if kept.count() > config.max_total_files:
        raise ValueError(f"Repository has more than {config.max_total_files} files")
    return kept


READ = 64 << 20  # bytes of contents handed on at once


def read_contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files with content; null where a file could not be read any more.

    On a mount, tasks open the files by their names. A task that finds neither a file nor the folder
    it lies in fails: its machine has no such mount. Elsewhere the engine reads them; it leaves out names
    that begin with _ , as that of a Python package's first file, and these, which are small, are read
    through the file system, a bounded part at a time.
    """
    if (one := files.select("path").first()) and not is_mounted(one[0]):
        return _read_remote(spark, files)
    columns = files.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            held, size, lost = [], 0, 0
            for row in part.itertuples(index=False, name=None):
                at = Path(row[columns.index("path")])
                try:
                    content = at.read_bytes()
                except OSError:
                    content = None
                    lost += not at.parent.is_dir()
                held.append((*row, content))
                size += len(content or b"")
                if size >= READ:
                    yield pd.DataFrame(held, columns=[*columns, "content"])
                    held, size = [], 0
            if len(part) and lost == len(part):
                raise OSError(f"no file of {lost} is there, nor its folder, as that of {part['path'].iloc[0]}; is the repository mounted on this machine?")
            yield pd.DataFrame(held, columns=[*columns, "content"])

    spread = files.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return spread.mapInPandas(run, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def _read_remote(spark: SparkSession, files: DataFrame) -> DataFrame:
    hidden = F.col("rel").rlike(r"(^|/)[_.][^/]*$")
    root = files.select(F.expr("substring(path, 1, length(path) - length(rel) - 1)")).first()[0]
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("_p"), "content")
    # the reader names files with its scheme spelled out; what follows the root is the same
    plain = files.filter(~hidden)
    at = f"{Folder(spark, root).qualified()}/"
    read = plain.join(whole.withColumn("_rel", F.expr(f"substring(_p, {len(at) + 1})")).drop("_p"), F.col("rel") == F.col("_rel"), "left").drop("_rel")
    folder, path, held, size = Folder(spark, root), work_path(spark, "hidden"), [], 0
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    spark.createDataFrame([], schema).write.parquet(path)
    for row in files.filter(hidden).toLocalIterator():
        try:
            content = folder.read_bytes(row["rel"])
        except Exception:  # noqa: BLE001  gone meanwhile
            content = None
        held.append((*row, content))
        size += len(content or b"")
        if size >= READ:
            spark.createDataFrame(held, schema).write.mode("append").parquet(path)
            held, size = [], 0
    if held:
        spark.createDataFrame(held, schema).write.mode("append").parquet(path)
    return read.unionByName(spark.read.schema(schema).parquet(path))
