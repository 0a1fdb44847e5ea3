"""Session settings that every plan relies on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: UTC keeps timestamps comparable; AQE splits skewed joins and merges small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Removes a write's shuffle files once it is done; what it wrote is read from the table only.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "graphloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; master is left to spark-submit where None."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the cluster names none, this raises; only a local master (tests) gets a folder of
    its own machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isDefined():
            return at.get()
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set; executors share no other folder")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_handed: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for tables that a result reads; release() deletes them."""
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}"
    _handed.append(path)
    return path


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """key is value inside; a session that does not know it, or fixes it, goes on without."""
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, value)
    except Exception:  # noqa: BLE001  a static setting
        yield
        return
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to a table of the shared folder and read back; its shuffle files go at once."""
    path = work_path(df.sparkSession, name)
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what work_path() has handed out in this process; results that read it end there."""
    from graphloom.sources.snapshots import Folder

    n = 0
    while _handed:
        Folder(spark, _handed.pop()).delete()
        n += 1
    return n


def ensure_checkpoint(spark: SparkSession) -> None:
    """checkpoint() has a folder to write to."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def ship(spark: SparkSession) -> None:
    """Executors can import this package: its sources go to them as a zip file, once an application."""
    import tempfile
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
    with zipfile.ZipFile(at, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(at))
    context._graphloom_shipped = True
