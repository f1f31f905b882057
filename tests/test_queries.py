"""Every named query against its SQL, value by value, on whole tables."""

import os

import pytest

import __spark_entry__ as contract
from panelsmith.plans import REGISTRY
from tests.compare import differences, sql_connection

FOLDER = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.01")
DUCK_TYPES = {  # fixed values: the SQL engine's name of each Spark type
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def sql():
    return sql_connection(FOLDER)


def test_every_query_has_sql():
    assert all(q.sql for q in REGISTRY.values())
    assert set(REGISTRY) <= set(contract.queries())


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, sql, name):
    df = contract.queries()[name](spark, FOLDER)
    want = sql.sql(contract.oracle_sql()[name])
    types = {f.name: DUCK_TYPES[f.dataType.simpleString()] for f in df.schema}
    assert types == {c: str(t) for c, t in zip(want.columns, want.types)}
    got = df.toPandas()
    assert len(got) > 0
    assert differences(got, want.df()) == []


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0
