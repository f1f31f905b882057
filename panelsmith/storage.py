"""Tables written to the shared folder, to cut lineage and to be read many times.

A panel is read by many signals.  Writing it once as Parquet keeps column
pruning for every later pass and survives the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Where everything of this application lies."""
    return f"{shared_folder(spark)}/panelsmith/{spark.sparkContext.applicationId}"


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever store its path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, none if it is not there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end; take or write the results before.

    Kept panels stay, since they serve later queries too.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def discard_all(spark: SparkSession) -> None:
    """Remove all that this application has written to the shared folder, kept panels too."""
    _kept.clear()
    delete(spark, own_folder(spark))


def settle(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    return _write(df, new_path(df.sparkSession, label), compression)


def _write(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Stored:
    """A written panel and the measured size of its largest day."""

    df: DataFrame
    path: str
    rows: int
    days: int
    max_day_rows: int


def settle_panel(df: DataFrame, label: str) -> Stored:
    """Write a panel and measure it: one small row comes back to the driver."""
    path = f"{own_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"  # outlives any scope
    table = _write(df, path)
    size = (
        table.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("days"), F.max("n").alias("top"))
        .first()
    )
    return Stored(table, path, size.rows or 0, size.days, size.top or 0)


def state_of(spark: SparkSession, paths: list[str]) -> tuple:
    """What tells one state of some files from another: their names, lengths and times.  Their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    digest = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
    return tuple(files.select("path", "length", "modificationTime").agg(F.count(F.lit(1)), digest).first())


_kept: dict[tuple, tuple[tuple, Stored, Stored | None]] = {}  # state of the files, the panel, the one before


def keep_panel(spark: SparkSession, label: str, source: str, build, tables: list[str]) -> Stored:
    """Build and write a panel at its first use in an application, then reuse it.

    ``tables`` of the folder ``source`` are what it is built from.  When their
    files have changed, the panel is built anew.  The one before stays for those
    who still read it, and is removed when the next takes its place.
    """
    key = (spark.sparkContext.applicationId, label, source)
    state = state_of(spark, [f"{source}/{t}.parquet" for t in tables])
    was, panel, before = _kept.get(key, (None, None, None))
    if was != state or not _readable(spark, panel.path):
        _kept[key] = (state, settle_panel(build(), label), panel)
        if before is not None:
            delete(spark, before.path)
    return _kept[key][1]


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:  # the shared folder was cleared
        return False
    return True
