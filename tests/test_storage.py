"""The store notices changed input and cleans up after itself."""

import os
import shutil
import time

import pytest

from panelsmith import storage
from panelsmith.plans import REGISTRY
from panelsmith.plans.inputs import panel

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    for name in ("lineitem", "supplier", "nation", "orders"):
        shutil.copy(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
        os.chmod(tmp_path / f"{name}.parquet", 0o644)
    return str(tmp_path)


def written(spark):
    top = storage.own_folder(spark).removeprefix("file:")
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_a_changed_table_is_noticed(spark, folder):
    first = panel(spark, folder)
    assert panel(spark, folder).path == first.path
    schema = spark.read.parquet(f"{folder}/lineitem.parquet").schema

    def replaced(n):
        some = spark.read.parquet(f"{folder}/lineitem.parquet").limit(n).toPandas()
        time.sleep(0.01)
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{folder}/new{n}")
        part = next(f for f in os.listdir(f"{folder}/new{n}") if f.endswith(".parquet"))
        os.replace(f"{folder}/new{n}/{part}", f"{folder}/lineitem.parquet")
        spark.catalog.refreshByPath(f"{folder}/lineitem.parquet")
        return panel(spark, folder)

    second = replaced(100)
    assert second.path != first.path and second.rows <= 100 < first.rows
    assert first.df.count() == first.rows  # a reader of the one before is not cut off
    third = replaced(50)
    assert third.path != second.path and os.path.basename(first.path) not in written(spark)
    assert second.df.count() == second.rows


def test_a_scope_leaves_no_table(spark, folder):
    panel(spark, folder)
    before = written(spark)
    with storage.scope(spark):
        assert REGISTRY["priority_at_shipment"].build(spark, folder).count() > 0
        assert written(spark) > before
    assert written(spark) == before
    with storage.scope(spark):
        kept = panel(spark, folder)
    assert kept.df.count() > 0
