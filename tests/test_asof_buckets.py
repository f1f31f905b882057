"""The stream's as-of join keeps many keys in one state."""

from panelsmith.streaming.asof import LEFT, RIGHT, LatestBefore

import pandas as pd


class State:
    def __init__(self):
        self.rows, self.timers = [], set()

    getListState = lambda self, *_: State()
    exists = lambda self: bool(self.rows)
    get = lambda self: iter(self.rows)
    appendList = lambda self, rows: self.rows.extend(rows)
    registerTimer = lambda self, at: self.timers.add(at)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class Now:
    getCurrentWatermarkInMs = lambda self: 10


def test_keys_of_a_bucket_share_state_and_timer_but_no_rows():
    join, handle = LatestBefore(None), State()
    join.init(handle)
    rows = [(RIGHT, "a", 1000, 1, "a1"), (RIGHT, "a", 4000, 2, "a4"), (RIGHT, "b", 2000, 3, "b2"), (LEFT, "a", 3000, 0, "at 3"),
            (LEFT, "b", 1000, 0, "at 1"), (LEFT, "b", 9000, 0, "at 9"), (LEFT, "c", 9000, 0, "none"), (LEFT, "a", 20000, 0, "later")]
    join.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["asof_side", "asof_key", "asof_at", "asof_tie", "asof_row"])]), None)
    assert handle.timers == {1}
    found = pd.concat(join.handleExpiredTimer((0,), Now(), None))
    assert sorted(map(tuple, found.astype(object).where(found.notna(), None).to_numpy().tolist()), key=str) == [
        ("at 1", None), ("at 3", "a1"), ("at 9", "b2"), ("none", None)]
    assert [w[3] for w in join.waiting.rows] == ["later"] and handle.timers == {1, 20}
    assert sorted(a[3] for a in join.latest.rows) == ["a4", "b2"]
