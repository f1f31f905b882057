"""Comparison of a query's rows with those of its SQL, value by value."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def sql_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def in_order(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="last", kind="stable").reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: ("time" if t.kind == "M" else t.kind) for c, t in df.dtypes.items() if t != object}


def differences(got: pd.DataFrame, want: pd.DataFrame, limit: int = 5) -> list[str]:
    """What differs between two results; empty when every value is the same."""
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}"]
    got, want = in_order(got), in_order(want)
    found = []
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype.kind == "M" or b.dtype.kind == "M":
            a, b = pd.to_datetime(a), pd.to_datetime(b)
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = (~same).idxmax()
            found.append(f"{c}: {int((~same).sum())} differ, first {a[at]!r} != {b[at]!r} in {got.loc[at].to_dict()}")
    return found[:limit]
