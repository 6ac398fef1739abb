"""Comparison of a registered query with its DuckDB SQL on the supplied tables."""

from __future__ import annotations

from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


def plain(value: object) -> str:
    return repr(float(value)) if isinstance(value, (float, Decimal)) else str(value)


def rows(found: list[tuple], columns: list[str]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def check(spark, query, sql: str, folder: str = FOLDER) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    ours, theirs = query(spark, folder), con.execute(sql)
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.collect(), ours.columns) == rows(theirs.fetchall(), columns)
