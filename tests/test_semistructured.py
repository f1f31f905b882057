"""JSON texts against plain Python: nested, malformed and missing ones, and drift from day to day."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelsmith.operators import semistructured as js
from tests.conftest import day

TEXTS = [
    '{"k": 1}', '{"k": 2.5, "s": "x"}', '{"k": null, "a": [1, {"b": true}, [2, 3]]}', '{"a": [], "o": {}}', "7", '"text"', "null", "[1, 2]",
    "{broken", "", '{"k": 1, "k": 2}', None, '{"deep": ' + '{"d": ' * 12 + "1" + "}" * 12 + "}", '{"ünï.x": 1, "k": -4, "big": 12345678901234}', '{"k": 1e300}',
]


def kind(v):
    for t, name in ((bool, "boolean"), (dict, "object"), (list, "array"), (int, "integer"), (float, "number"), (str, "string")):
        if isinstance(v, t):
            return name
    return "null"


def walk(v, path="$"):
    yield path, kind(v), v
    for k, inner in v.items() if isinstance(v, dict) else ():
        yield from walk(inner, f"{path}.{k}")
    for inner in v if isinstance(v, list) else ():
        yield from walk(inner, f"{path}[*]")


def found(text):
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key twice")
        return dict(pairs)

    if text is None:
        return [("$", "missing", None)]
    try:
        return list(walk(json.loads(text, object_pairs_hook=once)))
    except ValueError:
        return [("$", "malformed", None)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, props string").repartition(3)


def test_statistics_against_plain_python(texts):
    rows = [r for t in TEXTS for r in found(t)]
    want = Counter((p, k) for p, k, _ in rows)
    got = {(r.path, r.kind): r for r in js.path_statistics(texts, "props").collect()}
    assert {k: r.n for k, r in got.items()} == want
    for (path, k), r in got.items():
        numbers = [float(v) for p, q, v in rows if (p, q) == (path, k) and k in ("integer", "number")]
        assert (r.lowest, r.highest) == ((min(numbers), max(numbers)) if numbers else (None, None))


def test_values_keep_their_columns(texts):
    got = Counter((r.id, r.path, r.kind) for r in js.path_values(texts, "props", ["id"]).select("id", "path", "kind").collect())
    assert got == Counter((i, p, k) for i, t in enumerate(TEXTS) for p, k, _ in found(t))


def test_typed_columns(texts):
    got = {r.id: (r.k, r.b) for r in js.typed(texts, "props", {"k": ("$.k", "bigint"), "b": ("$.a[1].b", "boolean")}).collect()}
    assert got[0] == (1, None) and got[2] == (None, True) and got[8] == (None, None) and got[11] == (None, None) and got[13] == (-4, None)


def test_drift(spark):
    rows = [(0, '{"a": 1}'), (0, '{"b": "x"}'), (1, '{"a": 1.5}'), (1, "{broken"), (3, '{"a": 2.5}'), (3, '{"b": "y"}'), (None, '{"z": 1}')]
    df = spark.createDataFrame([(None if n is None else day(n), t) for n, t in rows], "d date, props string")
    got = {(r.d, r.path, r.kind, r.change, r.n) for r in js.drift(df, "props", "d").collect()}
    assert got == {
        (day(1), "$.a", "number", "new", 1), (day(1), "$.a", "integer", "gone", 0), (day(1), "$.b", "string", "gone", 0), (day(1), "$", "malformed", "new", 1),
        (day(3), "$.b", "string", "new", 1), (day(3), "$", "malformed", "gone", 0)}


def test_no_rows(texts):
    none = texts.limit(0).withColumn("d", F.current_date())
    assert js.path_statistics(none, "props").count() == 0 and js.drift(none, "props", "d").count() == 0
