"""Every registered query of the reference's own operators against its SQL."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from setwise.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="session")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    return f"{x:.9g}" if isinstance(x, float | Decimal) else x


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, sf_dir, name) -> None:
    got = QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in SQL:
        return
    want = oracle.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = [got.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[i]) for i in order) for r in rows) == Counter(tuple(map(plain, r)) for r in want.fetchall())
