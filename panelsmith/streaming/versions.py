"""Windows that are published early and corrected: the newest version of each counts.

In append mode a window comes out when the watermark has passed it, so the last
one of a feed never does.  Here every batch publishes the windows that it
changed, as a new version.  A version is known by the number of its batch and
lies in a folder of that number, so a batch that is run again after a failure
overwrites what it left and nothing is doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.storage import delete, listed, new_path

COMPACT_AFTER = 20  # batches between two compactions


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete folders of a kind, in order."""
    found = [name for name in listed(spark, path) if name.startswith(f"{kind}-")]
    return sorted(int(name.removeprefix(f"{kind}-")) for name in found if "_SUCCESS" in listed(spark, f"{path}/{name}"))


def _versions(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """All rows that may still be the newest: the last compacted table (before ``upto``) and the batches after it."""
    bases = [n for n in _numbers(spark, path, "base") if upto is None or n < upto]
    batches = [n for n in _numbers(spark, path, "batch") if (not bases or n > bases[-1]) and (upto is None or n <= upto)]
    folders = [f"{path}/base-{n}" for n in bases[-1:]] + [f"{path}/batch-{n}" for n in batches]
    return spark.read.parquet(*folders) if folders else None


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the largest ``version`` for each key; partly aggregated where the rows are read."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def current(spark: SparkSession, path: str, keys: list[str], schema=None) -> DataFrame:
    """Every window as last published, with the ``version`` (number of the batch) it is of.

    ``schema`` is for a table into which nothing has been published yet.
    """
    rows = _versions(spark, path)
    if rows is None:
        return spark.createDataFrame([], schema)
    return newest(rows, keys)


def publish(batch: DataFrame, number: int, path: str, keys: list[str], compact_after: int = COMPACT_AFTER) -> None:
    """Publish the windows that a batch changed.  Running it again with the same number changes nothing.

    Every so many batches the newest rows are written as one table, and what they
    replace is removed with the compaction after, so that a reader of the older
    files has that long to finish.
    """
    spark = batch.sparkSession
    batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{number}")
    if (number + 1) % compact_after:
        return
    newest(_versions(spark, path, number), keys).write.mode("overwrite").parquet(f"{path}/base-{number}")
    before = [n for n in _numbers(spark, path, "base") if n < number]
    for n in before[:-1]:
        delete(spark, f"{path}/base-{n}")
    for n in _numbers(spark, path, "batch"):
        if before and n <= before[-1]:
            delete(spark, f"{path}/batch-{n}")


def run_early(
    stream: DataFrame, keys: list[str], label: str, path: str | None = None, checkpoint: str | None = None, compact_after: int = COMPACT_AFTER,
) -> DataFrame:
    """Take in all files present, publish windows as they change, and return them as they are now.

    ``stream`` is an aggregate over windows; its columns ``keys`` tell a window
    apart.  A later call with the same ``path`` and ``checkpoint`` goes on where
    this one stopped.
    """
    spark = stream.sparkSession
    path, checkpoint = path or new_path(spark, label), checkpoint or new_path(spark, f"{label}-progress")
    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).queryName(label)
        .foreachBatch(lambda batch, number: publish(batch, number, path, keys, compact_after))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = stream.select("*", F.lit(0).cast("long").alias("version")).schema
    return current(spark, path, keys, schema)
