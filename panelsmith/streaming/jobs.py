"""Running a stream over the files that are there, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelsmith.session import ROCKSDB, STATE_STORE
from panelsmith.storage import new_path


KEPT = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions")


def state_session(spark: SparkSession) -> SparkSession:
    """``spark`` if its streams keep state in RocksDB, else a session beside it that does.

    The settings of ``spark`` stay as they are, so streams started side by side
    do not change each other's.
    """
    if spark.conf.get(STATE_STORE) == ROCKSDB:
        return spark
    beside = spark.newSession()
    for name in KEPT:
        beside.conf.set(name, spark.conf.get(name))
    beside.conf.set(STATE_STORE, ROCKSDB)
    return beside


def run_to_table(
    stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None, own_state: bool = False
) -> DataFrame:
    """Take in all files present, append to a Parquet table and return that table.

    A later call with the same ``path`` and ``checkpoint`` goes on where this
    one stopped.  State is kept where the session says; ``own_state`` is for
    processors with state variables, which need the RocksDB store set there.
    """
    spark = stream.sparkSession
    if own_state and spark.conf.get(STATE_STORE) != ROCKSDB:
        raise ValueError("state variables need the RocksDB store: start the stream in state_session(spark)")
    path = path or new_path(spark, label)
    checkpoint = checkpoint or new_path(spark, f"{label}-progress")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .queryName(label).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
