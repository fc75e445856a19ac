"""Session helpers: the shared folder of the cluster and staged tables that cut lineage."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder under /tmp; a cluster session must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_open_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("open_scopes", default=())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The written table survives the loss of executors, can be column-pruned, and fixes values that would
    otherwise depend on how a shuffle was run (partition ids, numbering). Inside ``passing`` it is deleted at the end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    scopes = _open_scopes.get()
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    """The store that holds a path, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store holds it; one that is not there is no error."""
    store, found = _file_system(spark, path)
    store.delete(found, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    store, found = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(found)) if store.exists(found) else []


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless there is one of that name; whether it was written."""
    store, found = _file_system(spark, path)
    part = found.suffix(f".{uuid.uuid4().hex}.part")
    out = store.create(part, False)
    out.write(text.encode())
    out.close()
    # A rename onto a file that exists fails, so the first writer of a name wins and no reader sees half a file.
    done = not store.exists(found) and store.rename(part, found)
    if not done:
        store.delete(part, False)
    return done


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block are deleted when it ends, whether it ends well or not.

    What leaves the block must be a table that ``lasting`` has written. A written table has no lineage, so no retry of a
    later task can ask for a deleted one.
    """
    scopes = _open_scopes.get()
    own: list[str] = []
    token = _open_scopes.set((*scopes, own))
    try:
        yield
    finally:
        _open_scopes.reset(token)
        for path in own:
            remove(spark, path)


def lasting(df: DataFrame, name: str) -> DataFrame:
    """Like ``staged``, but the table belongs to the block around the innermost one and outlives that one."""
    scopes = _open_scopes.get()
    token = _open_scopes.set(scopes[:-1])
    try:
        return staged(df, name)
    finally:
        _open_scopes.reset(token)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written inside the block goes to Python in batches of at most so many rows, for rows that hold long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def one_split_order(spark: SparkSession) -> Iterator[None]:
    """A file that is scanned inside the block has a partition per split, in order, of as many bytes as a split may have."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_or_none(df: DataFrame, max_rows: int) -> list | None:
    """Rows of ``df`` if there are at most ``max_rows`` of them, else None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def finite(column: Column) -> Column:
    """NaN and infinities become NULL."""
    value = column.cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)
