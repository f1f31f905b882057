import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelsmith.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g", "panelsmith-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="session")
def small_panel(spark):
    """A missing price, ties, a date gap, a constant series and an asset with one row."""
    rows = [
        (1, 0, day(0), 10.0, 5.0), (1, 0, day(1), None, 6.0), (1, 0, day(2), 12.0, 5.0), (1, 0, day(5), 12.0, 7.0),
        (2, 0, day(0), 8.0, 5.0), (2, 0, day(1), 8.0, 5.0), (2, 0, day(2), 8.0, 5.0), (2, 0, day(3), 8.0, 5.0),
        (3, 1, day(0), 3.0, 1.0),
        (4, 1, day(0), 7.0, 2.0), (4, 1, day(2), 9.0, 2.0), (4, 1, day(3), 6.0, 4.0),
    ]
    return spark.createDataFrame(rows, "asset long, grp int, d date, px double, vol double")


@pytest.fixture(scope="session")
def random_panel(spark):
    """40 assets over 120 days with gaps, missing prices and one very busy value."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = []
    for asset in range(40):
        for n in range(120):
            if rng.random() < 0.25:
                continue
            px = None if rng.random() < 0.05 else round(50 + 10 * float(rng.standard_normal()), 2)
            vol = 1.0 if rng.random() < 0.35 else float(rng.integers(1, 30))
            rows.append((asset, asset % 4, day(n), px, vol))
    return spark.createDataFrame(rows, "asset long, grp int, d date, px double, vol double").cache()
