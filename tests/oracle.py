"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return db


def _plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def assert_same(df, sf_dir: str, sql: str) -> None:
    answer = duck(sf_dir).execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(names)
    want, got = rows_of(names, answer.fetchall()), rows_of(df.columns, df.collect())
    assert len(want) == len(got)
    assert want == got
