"""Joins on equal keys and an inequality, by blocks, against pairs made one by one."""

from __future__ import annotations

import operator
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from setwise.plans import dialect, range_join
from setwise.plans.catalogue import QUERIES

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@pytest.fixture
def small(monkeypatch) -> None:
    monkeypatch.setattr(range_join, "BLOCK", 4)
    monkeypatch.setattr(range_join, "CELL", 8)
    monkeypatch.setattr(range_join, "DENSE", 0)


@pytest.fixture(scope="module")
def rows(spark) -> tuple[list[tuple], list[tuple]]:
    """Nulls, ties, equal rows, a large key, keys of one side only; values of which none, some and all match."""
    r = random.Random(7)
    made = []
    for name, n, low in (("t_left", 150, 0), ("t_right", 170, 20)):
        values = [(k, r.choice([None, "a", "a", "a", "b", name]), r.choice([None, 1, 2]), r.choice([None, Decimal(low + r.randrange(60)), Decimal(40)])) for k in range(n)]
        made.append(values + values[:30])
        spark.createDataFrame(made[-1], "_id bigint, kind string, `group` bigint, price decimal(18,2)").createOrReplaceTempView(name)
    return tuple(made)


def pairs(rows, op: str, keys: tuple[int, ...] = (1,)) -> list[tuple]:
    return [(p, q) for p in rows[0] for q in rows[1] if None not in (p[3], q[3], *(p[k] for k in keys)) and all(p[k] == q[k] for k in keys) and OPS[op](p[3], q[3])]


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("turned", [False, True])
def test_all_pairs(spark, small, rows, op, turned) -> None:
    test = f"q.price {op.translate(str.maketrans('<>', '><'))} p.price" if turned else f"p.price {op} q.price"
    text = f"SELECT p._id, q._id AS b, q.price FROM t_left p JOIN t_right AS q ON {test} AND p.kind = q.kind"
    assert "_range_all" in dialect.to_spark(text, None, spark)
    got = dialect.select(spark, text)
    assert got.columns == ["_id", "b", "price"]
    assert Counter(map(tuple, got.collect())) == Counter((p[0], q[0], q[3]) for p, q in pairs(rows, op))


def test_two_keys_and_clauses(spark, small, rows) -> None:
    text = "SELECT p.kind, count(q.price) FROM t_left p INNER JOIN t_right q ON p.kind = q.kind AND q.group = p.group AND p.price < q.price WHERE q.price > 45 OR p._id = 3 GROUP BY p.kind ORDER BY p.kind"
    assert "_range_all" in dialect.to_spark(text, None, spark)
    got = dialect.select(spark, text)
    want = Counter(p[1] for p, q in pairs(rows, "<", (1, 2)) if q[3] > 45 or p[0] == 3)
    assert got.columns == ["kind", "count(price)"]
    assert list(map(tuple, got.collect())) == sorted(want.items())


def test_one_side_read(spark, small, rows) -> None:
    want = pairs(rows, "<")
    for text, at in (("SELECT q._id", 1), ("SELECT p._id", 0)):
        got = dialect.select(spark, f"{text} FROM t_left p JOIN t_right q ON p.kind = q.kind AND p.price < q.price")
        assert Counter(r[0] for r in got.collect()) == Counter(x[at][0] for x in want)
    got = dialect.select(spark, "SELECT count(*) AS n FROM t_left p JOIN t_right q ON p.kind = q.kind AND p.price < q.price")
    assert got.first()["n"] == len(want)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM t_left p JOIN t_right q ON p.kind = q.kind AND p.price < q.price",
        "SELECT p.* FROM t_left p JOIN t_right q ON p.kind = q.kind AND p.price < q.price",
        "SELECT p._id AS a FROM t_left p LEFT JOIN t_right q ON p.kind = q.kind AND p.price < q.price",
        "SELECT p._id AS a FROM t_left p JOIN t_right q ON p.kind = q.kind OR p.price < q.price",
        "SELECT p._id AS a FROM t_left p JOIN t_right q ON p.kind = q.kind AND p.price < q._id",
        "SELECT p._id AS a FROM t_left p JOIN (SELECT TOP(9) * FROM t_right) q ON p.kind = q.kind AND p.price < q.price",
    ],
)
def test_left_to_spark(spark, small, rows, text) -> None:
    assert "_range_all" not in dialect.to_spark(text, None, spark)
    dialect.select(spark, text).collect()


def test_one_key_is_dealt(spark, small, sf_dir, tmp_path) -> None:
    """Pairs of one size are made by several tasks, and none is lost."""
    n = 300
    for name in ("nation", "orders", "lineitem", "customer", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(1).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(n).coalesce(1).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "7 AS p_size", "cast(id % 100 AS double) AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["sql_theta_join"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert Counter((r["a"], r["b"]) for r in got) == Counter((a, b) for a in range(n) for b in range(n) if a % 100 < b % 100)
    tasks = Counter(r["task"] for r in got)
    assert len(tasks) > 1 and max(tasks.values()) < 0.6 * len(got)
