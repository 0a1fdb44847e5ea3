"""Snapshots of several tables under one path.

Tables are written aside, each time to a folder of its own, and become visible together by
one rename: that of a manifest, a small file that names the folders of a version. Readers take
the folders of one manifest, so that what they see is of one version, whatever is being
written; a run that dies in between leaves the version before it. Two writers that began
from the same version cannot both finish: the second finds the next manifest's name
taken and raises Conflict.

A keyed table is cut into buckets by a hash of its key. merge() rewrites the buckets that
the new rows fall into, and the manifest takes the others from where they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Folder:
    """A folder of the session's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at("").getFileSystem(self.conf)

    def names(self, name: str = "") -> list[str]:
        fs, at = self._fs(), self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def files(self) -> Iterator[tuple[str, int]]:
        """Path from here, and length, of every file below, in the order of the file system."""
        fs, at = self._fs(), self._at("")
        base = fs.makeQualified(at).toString().rstrip("/") + "/"
        found = fs.listFiles(at, True)
        while found.hasNext():
            status = found.next()
            yield status.getPath().toString().removeprefix(base), status.getLen()

    def qualified(self) -> str:
        return self._fs().makeQualified(self._at("")).toString().rstrip("/")

    def is_folder(self) -> bool:
        fs, at = self._fs(), self._at("")
        return fs.exists(at) and fs.getFileStatus(at).isDirectory()

    def read_bytes(self, name: str) -> bytes:
        stream = self._fs().open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs().create(self._at(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        """Whether the file got the new name; False if that is taken."""
        if self._fs().exists(self._at(new)):
            return False
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.conf)
        plain = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(self._at(old)), context.makeQualified(self._at(new)), plain)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, name: str = "") -> None:
        self._fs().delete(self._at(name), True)


class Snapshots:
    """Versions of named tables. An entry describes a table's folders, and stands in manifests."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    # --- versions ---

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("manifests") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default of the last; version 0 has no tables."""
        version = max(self.versions(), default=0) if version is None else version
        return json.loads(self.folder.read(f"manifests/{version:012d}.json")) if version else {"version": 0, "tables": {}}

    def commit(self, entries: dict[str, dict], base: dict) -> dict:
        """Make the version after base, with the entries in place of base's; Conflict if there is one already."""
        new = {"version": base["version"] + 1, "time": datetime.now(UTC).isoformat(), "tables": base["tables"] | entries}
        aside = f"manifests/_{uuid.uuid4().hex}"
        self.folder.write(aside, json.dumps(new))
        if not self.folder.rename(aside, f"manifests/{new['version']:012d}.json"):
            self.folder.delete(aside)
            raise Conflict(f"version {new['version']} of {self.path} has been written by another")
        return new

    def expire(self, keep: int = 2) -> int:
        """Delete all but the last versions, and folders that none of these names; how many folders went.

        It also takes what writers have left that died, and so must not run beside a writer.
        """
        old = self.versions()[: -max(1, keep)]
        for version in old:
            self.folder.delete(f"manifests/{version:012d}.json")
        for name in self.folder.names("manifests"):
            if name.startswith("_"):
                self.folder.delete(f"manifests/{name}")
        used = {d.rpartition(f"/{BUCKET}=")[0] or d for v in self.versions() for e in self.manifest(v)["tables"].values() for d in e["folders"].values()}
        gone = [d for t in self.folder.names("data") for n in self.folder.names(f"data/{t}") if (d := f"data/{t}/{n}") not in used]
        for d in gone:
            self.folder.delete(d)
        return len(gone)

    # --- tables ---

    def write(self, name: str, df: DataFrame, partition_by: Iterable[str] = ()) -> dict:
        """Write a whole table aside; the entry to commit."""
        at = f"data/{name}/{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{at}")
        return {"folders": {"": at}}

    def write_keyed(self, name: str, df: DataFrame, key: list[str], buckets: int = 64) -> dict:
        """Write a table aside that merge() can change; rows that repeat a key raise."""
        return self._put(name, df, {"folders": {}, "key": key, "buckets": buckets}, buckets)

    def merge(self, name: str, rows: DataFrame, entry: dict) -> dict:
        """The table with rows, each in place of the row of its key; only buckets that rows fall into are written.

        Returns the entry itself if there is no row.
        """
        key = entry["key"]
        new = self._put(name, rows, entry | {"folders": {}}, entry["buckets"], "incoming")
        touched = new["folders"]
        if not touched:
            return entry
        fresh = self.read_entry(new, rows.schema)
        old = self.read_entry(entry | {"folders": {b: d for b, d in entry["folders"].items() if b in touched}}, rows.schema)
        kept = old.join(fresh.select(*key), key, "left_anti")
        done = self._put(name, kept.unionByName(fresh), entry, entry["buckets"])
        self.folder.delete(next(iter(touched.values())).rpartition("/")[0])
        return done

    def _put(self, name: str, df: DataFrame, entry: dict, buckets: int, label: str = "") -> dict:
        """Rows by bucket in a new folder, and the entry with these buckets in place of its own."""
        at = f"data/{name}/{label}{uuid.uuid4().hex}"
        dealt = df.withColumn(BUCKET, bucket_of(entry["key"], buckets)).repartition(BUCKET, *entry["key"])
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{at}")
        written = {n.partition("=")[2]: f"{at}/{n}" for n in self.folder.names(at) if n.startswith(f"{BUCKET}=")}
        self._check_keys(self.read_entry(entry | {"folders": written}, df.schema), entry["key"])
        return entry | {"folders": entry["folders"] | written}

    @staticmethod
    def _check_keys(df: DataFrame, key: list[str]) -> None:
        if twice := df.groupBy(*key).count().filter("count > 1").head(1):
            raise ValueError(f"Repeated key: {', '.join(map(str, twice[0][:-1]))}")

    def read_entry(self, entry: dict | None, schema: T.StructType) -> DataFrame:
        folders = [f"{self.path}/{d}" for d in entry["folders"].values()] if entry else []
        return self.spark.read.schema(schema).parquet(*folders).select(*schema.names) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, schema: T.StructType, manifest: dict | None = None) -> DataFrame:
        """A table of a version, by default of the last; empty if it has none."""
        return self.read_entry((manifest or self.manifest())["tables"].get(name), schema)


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
