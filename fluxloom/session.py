"""Shared storage for intermediate tables, and the size checks before a broadcast or a collect."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Shuffle files go when the query that made them ends, not when the driver happens to collect its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# A dictionary table above this many bytes of keys and values is joined by shuffle, not broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


class TooLarge(ValueError):
    """A table that must fit one process (a model, a feature dictionary) is above its bound."""


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; the cluster names it in spark.checkpoint.dir."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="fluxloom-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


_owned: set[str] = set()
# Paths written since each `settle_alone` that has not ended, the innermost last.
_open: list[list[str]] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the driver's Python ends."""
    root = f"{shared_dir(spark)}/fluxloom/{spark.sparkContext.applicationId}"
    if root not in _owned:
        _owned.add(root)
        atexit.register(_remove, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def _remove(jvm, configuration, root: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(configuration).delete(path, True)
    except Exception as error:  # the JVM may be gone already; the folder then stays, and is named
        print(f"not removed: {root} ({type(error).__name__})")


def settle(df: DataFrame, tag: str = "settled", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Lineage ends at the files, so a lost executor re-reads them, and Catalyst knows the real size of
    the table: a join against it is broadcast only while the files are below
    ``spark.sql.autoBroadcastJoinThreshold``, and is a shuffle join (split on skew by AQE) beyond.
    The shuffle files of the write are removed with its end, so disk holds those of one write, not of all before.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write(df, tag, partition_by))


def write(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> str:
    """The path of ``df``, written to the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    if _open:
        _open[-1].append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)
    return path


def settle_alone(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """`settle` of what ``make`` returns. The tables that ``make`` wrote on its way go as soon as this one is written, so the
    shared folder holds the result only; nothing else may read them."""
    _open.append([])
    try:
        df = make()
    except BaseException:
        _open.pop()
        raise
    spent = _open.pop()
    found = settle(df, tag)
    for path in spent:
        _remove(spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return found


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must be small. Reads at most ``limit + 1`` rows; raises above the limit."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"{what} has more than {limit} rows")
    return rows


def bounded_table(df: DataFrame, limit: int, what: str) -> pa.Table:
    """The same as an Arrow table, for models of many numbers: no Python object is made per value."""
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        raise TooLarge(f"{what} has more than {limit} rows")
    return table.combine_chunks()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Needed where it is not installed on the cluster: functions that run in tasks import it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fluxloom-package-")) / "fluxloom.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
