"""Change points against a plain walk, and differences of two versions of a panel."""

import random

import pytest
from pyspark.sql import functions as F

from panelsmith.operators import reconcile
from panelsmith.operators.changes import change_points
from panelsmith.storage import new_path
from tests.conftest import day


def plain_alarms(series, allowance, limit):
    up = down = 0.0
    since_up = since_down = None
    for d, z in series:
        if z is None or z != z:
            continue
        up, down = max(0.0, up + z - allowance), max(0.0, down - z - allowance)
        since_up, since_down = (since_up or d) if up > 0 else None, (since_down or d) if down > 0 else None
        if max(up, down) > limit:
            side = "up" if up >= down else "down"
            yield since_up if side == "up" else since_down, d, side, max(up, down)
            up = down = 0.0
            since_up = since_down = None


def test_alarms_against_a_plain_walk(spark):
    rng = random.Random(3)
    series = {a: [(day(n), None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else rng.gauss((a % 3 - 1) * (n > 40), 1)) for n in range(120)] for a in range(15)}
    rows = [(a, d, z) for a, s in series.items() for d, z in s]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + [(99, None, 50.0)], "asset long, d date, z double").repartition(4)
    got = sorted((r.asset, r.since, r.d, r.side, r.score) for r in change_points(df, "z", 0.5, 4.0).collect())
    want = sorted((a, *alarm) for a, s in series.items() for alarm in plain_alarms(s, 0.5, 4.0))
    assert got == want and {w[3] for w in want} == {"up", "down"}
    assert change_points(df.limit(0), "z").count() == 0


def test_a_long_history_streams_through_a_task(spark):
    """Two hundred thousand rows of one asset: alarms come at a steady pace."""
    df = spark.range(200_000).select(F.lit(1).alias("asset"), F.date_add(F.lit(day(0)), F.col("id").cast("int")).alias("d"), F.lit(1.0).alias("z"))
    assert change_points(df, "z", 0.5, 4.75).count() == 20_000  # ten steps of a half each


PANEL = "asset long, d date, px double, vol double"


def panel_rows():
    return {(a, n): (float(a + n), float(n)) for a in range(40) for n in range(30)}


def frame(spark, rows):
    return spark.createDataFrame([(a, None if n is None else day(n), *v) for (a, n), v in rows.items()], PANEL)


def changes(df):
    return sorted((r.asset, str(r.d), r.column, r.change, str(r.old), str(r.new)) for r in df.collect())


def test_cells_that_differ(spark):
    old = panel_rows() | {(7, None): (1.0, 2.0), (8, 3): (float("nan"), None)}
    new = dict(old)
    new[5, 4] = (9.0, 5.0)  # both cells
    new[6, 4] = (new[6, 4][0], None)
    del new[9, 9]
    new[99, 10] = (1.5, None)
    new[7, None] = (1.0, 3.0)
    want = []
    for key in old.keys() | new.keys():
        for i, name in enumerate(("px", "vol")):
            o, n = old.get(key, (None, None))[i], new.get(key, (None, None))[i]
            change = "added" if key not in old else "removed" if key not in new else "changed"
            if change != "changed" or not (o == n or (o is not None and n is not None and o != o and n != n)):
                want.append((key[0], str(None if key[1] is None else day(key[1])), name, change, str(o), str(n)))
    got = changes(reconcile.differences(frame(spark, old), frame(spark, new).repartition(5), ["px", "vol"]))
    assert got == sorted(want)
    assert reconcile.differences(frame(spark, old), frame(spark, old).repartition(3), ["px", "vol"]).count() == 0


def test_one_changed_cell_reads_one_branch(spark):
    old = panel_rows()
    new = old | {(5, 4): (0.0, 4.0)}
    trees = [reconcile.tree(frame(spark, rows)) for rows in (old, new)]
    found = reconcile.differing_branches(*trees).collect()
    assert [r.day for r in found] == [day(4)]
    path = new_path(spark, "test-version")
    frame(spark, new).write.partitionBy("d").parquet(path)
    stored = spark.read.parquet(path).select("asset", "d", "px", "vol")
    diff = reconcile.differences(frame(spark, old), stored, ["px", "vol"], trees=tuple(trees))
    assert changes(diff) == [(5, str(day(4)), "px", "changed", "9.0", "0.0")]
    assert len({f for f in stored.filter(reconcile.within(F.col("d"), [day(4)])).inputFiles()}) >= 1
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan  # other days' folders are not opened


def test_repeated_rows_of_a_differing_branch_are_an_error(spark):
    old, new = frame(spark, panel_rows()), frame(spark, panel_rows())
    with pytest.raises(Exception, match="repeated row"):
        reconcile.differences(old, new.unionByName(new.filter("asset = 3 and px = 5")), ["px", "vol"]).collect()


def test_alarms_come_from_batches_after_one_placing(spark, capsys):
    """No row is handed to Python by itself, and rows that a window has placed by asset are not moved again."""
    from pyspark.sql import Window

    df = spark.createDataFrame([(a, day(n), float(n % 7 * a)) for a in range(5) for n in range(60)], "asset long, d date, v double").repartition(3)
    scored = df.select("asset", "d", (F.col("v") - F.avg("v").over(Window.partitionBy("asset").orderBy("d").rowsBetween(-20, -1))).alias("z"))
    capsys.readouterr()
    change_points(scored, "z").explain("formatted")
    text = capsys.readouterr().out
    assert "MapInArrow" in text and "UDTF" not in text
    assert text.count("hashpartitioning") == 1


def test_a_new_asset_and_a_new_stretch_of_a_batch(spark, monkeypatch):
    """Sums end with their asset and go on from one stretch of a batch to the next."""
    from panelsmith.operators import changes

    monkeypatch.setattr(changes, "STRETCH", 3)
    rows = [(a, day(n), 1.0) for a in (None, 1, 2) for n in range(8)]  # steps of a half: 4.0 at the end, never above
    df = spark.createDataFrame(rows, "asset long, d date, z double")
    assert change_points(df, "z", 0.5, 4.0).count() == 0
    got = sorted((str(r.asset), r.since, r.d, r.side, r.score) for r in change_points(df, "z", 0.5, 3.5).collect())
    assert got == [(str(a), day(0), day(7), "up", 4.0) for a in (1, 2, None)]
