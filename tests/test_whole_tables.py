"""Queries that once left rows of their tables out, against the tables read without Spark."""

from __future__ import annotations

from decimal import Decimal

import pyarrow.parquet as pq
import pytest

from setwise.functions import percentile
from setwise.plans.catalogue import QUERIES
from setwise.plans.samples import customers_with_sets


def table(sf_dir: str, name: str) -> list[dict]:
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def test_theta_join_takes_all_parts(spark, sf_dir) -> None:
    parts = [(r["p_partkey"], r["p_size"], round(r["p_retailprice"], 2)) for r in table(sf_dir, "part")]
    want = sorted((a, b) for a, s, x in parts for b, t, y in parts if s == t and x < y)
    assert sorted((r["a"], r["b"]) for r in QUERIES["sql_theta_join"](spark, sf_dir).collect()) == want


def test_sets_hold_all_urgent_and_high_orders(spark, sf_dir) -> None:
    want = {r["c_custkey"]: set() for r in table(sf_dir, "customer")}
    for r in table(sf_dir, "orders"):
        if r["o_orderpriority"] < "3" and r["o_custkey"] in want:
            want[r["o_custkey"]].add(r["o_orderpriority"])
    got = {r["_id"]: set(r["priorities"] or ()) for r in customers_with_sets(spark, sf_dir).collect()}
    assert got == want


def bisected(values: list[int], nth: int) -> int:
    """Halves the domain between the extremes, counting all values at every step."""
    less, greater = len(values) * nth // 100, len(values) * (100 - nth) // 100
    low, high = min(values), max(values)
    at = low
    while low < high:
        at = (low + high) // 2
        if sum(x < at for x in values) > less:
            high = at - 1
        elif sum(x > at for x in values) > greater:
            low = at + 1
        else:
            break
    return at


@pytest.mark.parametrize("steps", [1, 10])
def test_inner_percentiles(spark, sf_dir, monkeypatch, steps) -> None:
    monkeypatch.setattr(percentile, "STEPS", steps)
    cents = [int(r["o_totalprice"]) % 100 for r in table(sf_dir, "orders") if r["o_orderstatus"] == "F"]
    prices = [round(r["p_retailprice"] * 100) for r in table(sf_dir, "part")]
    got = QUERIES["pql_percentile_50"](spark, sf_dir).first()
    assert (got["value"], got["count"]) == (bisected(cents, 50), len(cents))
    got = QUERIES["pql_percentile_99"](spark, sf_dir).first()
    assert (got["value"], got["count"]) == (Decimal(bisected(prices, 99)).scaleb(-2), len(prices))
