"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from panelsmith.plans import REGISTRY
from panelsmith.plans.inputs import long_signals, panel, panel_from_tables
from panelsmith.operators import evaluation as ev
from panelsmith.operators import quality
from panelsmith.sources.tables import SchemaMismatch, load, schema_of
from panelsmith.storage import settle, shared_folder

FOLDER = "/root/testdata/sf0.01"
PYTHON_ALLOWED = {"section_regression_residual", "lagged_signal_correlations", "volume_change_points"}
STREAMS = {n for n in REGISTRY if n.startswith("stream_")}


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - STREAMS))
def test_no_cross_join_and_no_python_in_the_hot_path(spark, capsys, name):
    text = plan(REGISTRY[name].build(spark, FOLDER), capsys)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_ALLOWED:
        assert "EvalPython" not in text and "InPandas" not in text


def test_panel_scan_reads_four_columns_and_sums_before_the_shuffle(spark, capsys):
    text = plan(panel_from_tables(spark, FOLDER, "supplier"), capsys)
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate:timestamp_ntz>" in text
    assert "partial_sum" in text


def test_date_range_reaches_the_scan_of_a_stored_panel(spark, capsys):
    stored = panel(spark, FOLDER).df
    text = plan(stored.filter(F.col("d") >= "2000-01-01").select("asset", "px"), capsys)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(d", text)
    assert "vol" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_daily_ic_of_known_size_shuffles_once(spark, capsys):
    df, rows = long_signals(spark, FOLDER)
    text = plan(ev.daily_ic(df, group_rows=rows), capsys)
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1
    text = plan(ev.ic_decay(df, [1, 5], group_rows=rows), capsys)
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 2  # and one for the sums over days


def test_joins_by_keys_that_are_never_null_keep_the_placing(spark, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(quality.outliers(panel(spark, FOLDER).df, "px", 3.0), capsys)
        assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_schema_mismatch_is_reported(spark, tmp_path):
    spark.range(3).select(F.col("id").cast("int").alias("r_regionkey")).write.parquet(str(tmp_path / "region.parquet"))
    with pytest.raises(SchemaMismatch, match="r_name: wanted string, found nothing"):
        load(spark, str(tmp_path), "region")


def test_column_order_in_the_file_does_not_matter(spark, tmp_path):
    df = load(spark, FOLDER, "nation")
    df.select(*reversed(df.columns)).write.parquet(str(tmp_path / "nation.parquet"))
    assert load(spark, str(tmp_path), "nation").schema.names == schema_of("nation").names


def test_settled_table_lies_in_the_shared_folder(spark):
    table = settle(spark.range(5).toDF("x"), "five")
    assert table.count() == 5
    assert all(shared_folder(spark).split(":")[-1] in f for f in table.inputFiles())
