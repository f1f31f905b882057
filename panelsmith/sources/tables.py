"""Parquet tables with fixed schemas (no inference, checked on load)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Column names and types of the input tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class SchemaMismatch(ValueError):
    """A stored table lacks a column or holds it with another type."""


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def check_schema(stored: T.StructType, wanted: T.StructType, name: str) -> None:
    have = {f.name: f.dataType for f in stored}
    wrong = [
        f"{f.name}: wanted {f.dataType.simpleString()}, "
        f"found {have[f.name].simpleString() if f.name in have else 'nothing'}"
        for f in wanted
        if have.get(f.name) != f.dataType
    ]
    if wrong:
        raise SchemaMismatch(f"{name}: " + "; ".join(wrong))


def load(spark: SparkSession, folder: str, name: str, check: bool = True) -> DataFrame:
    """Table ``name`` of ``folder``, columns in the declared order.

    With ``check`` the stored footer is compared with the declared schema
    first; a plain ``schema(...)`` would read a missing column as NULL.
    """
    path = f"{folder}/{name}.parquet"
    wanted = schema_of(name)
    if check:
        check_schema(spark.read.parquet(path).schema, wanted, name)
    return spark.read.schema(wanted).parquet(path)


FILES_PER_TRIGGER = 64


def load_stream(
    spark: SparkSession, folder: str, name: str, files_per_trigger: int = FILES_PER_TRIGGER, check: bool = True
) -> DataFrame:
    """The table as an unbounded stream of files, so many of them in a batch at most.

    The path is written as a pattern because the file source takes a folder of
    files or a pattern, but not the bare name of one file.  With ``check`` the
    schema of what is there already is compared first, as in ``load``.
    """
    wanted, path = schema_of(name), f"{folder}/{name}.[p]arquet"
    if check:
        check_schema(spark.read.parquet(path).schema, wanted, name)
    return spark.readStream.schema(wanted).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
