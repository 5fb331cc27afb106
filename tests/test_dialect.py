"""What the dialect means where Spark's own SQL differs, and what it rejects."""

from __future__ import annotations

from decimal import Decimal

import pytest

from setwise.functions import percentile
from setwise.plans.calls import CallError, parse
from setwise.plans.dialect import DialectError, to_spark
from setwise.plans.statements import Session


@pytest.fixture
def session(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/store")
    s.run("CREATE TABLE t (_id id, a int, b int, d decimal(2), e decimal(3), s1 idset, s2 idset, q stringsetq timequantum 'YMD' ttl '1d')")
    s.run("CREATE TABLE u (_id id, a int)")
    s.run("INSERT INTO t (_id, a, b, d, e, s1, s2, q) VALUES (1, 7, 2, 10, 3, [1, 2], [2, 1], {'2000-01-02T00:00:00Z', ['x']}), (2, -7, 2, 10, 7, [1, 2, 3], [1], {'2030-01-02T00:00:00Z', ['y']}), (3, 9, 4, 12.5, 2, [1], [1, 2], ['z'])")
    s.run("INSERT INTO u (_id, a) VALUES (1, 1), (2, 2), (3, 3), (4, 4), (5, 5)")
    return s


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_division_truncates(session) -> None:
    assert rows(session.run("SELECT _id, a / b AS x, a / 2 * 3 AS y, 100 - a / b AS z, (a + 1) / b AS w FROM t")) == [(1, 3, 9, 97, 4), (2, -3, -9, 103, -3), (3, 2, 12, 98, 2)]
    assert rows(session.run("SELECT _id, d / e AS x FROM t")) == [(1, Decimal("3.333")), (2, Decimal("1.428")), (3, Decimal("6.250"))]
    assert rows(session.run("SELECT sum(a) / count(*) AS x FROM t AS y WHERE y.a / 2 > 3")) == [(9,)]
    assert rows(session.run("SELECT x FROM (SELECT 7 / 2 AS x) AS y")) == [(3,)]
    assert rows(session.run("SELECT t._id FROM t INNER JOIN u ON t._id = u._id AND t.a / t.b = u.a + 2")) == [(1,)]


def test_sets_compare_as_sets(session) -> None:
    assert rows(session.run("SELECT _id FROM t WHERE s1 = s2")) == [(1,), (2,)]
    assert rows(session.run("SELECT x._id FROM t x WHERE x.s1 != x.s2 AND x.a = x.a")) == [(3,)]
    assert rows(session.run("SELECT _id FROM t WHERE s1 = [1, 2] AND _id = 1")) == [(1,)]


def test_top_belongs_to_its_select(session) -> None:
    assert rows(session.run("SELECT _id FROM u WHERE _id IN (SELECT TOP(1) _id FROM t ORDER BY _id DESC)")) == [(3,)]
    assert len(rows(session.run("SELECT u._id FROM u, (SELECT TOP(1) _id FROM t ORDER BY _id) AS x"))) == 5
    assert len(rows(session.run("SELECT DISTINCT TOP(2) _id FROM u"))) == 2


def test_ranges_and_hints_belong_to_their_table(session) -> None:
    wide = "RANGEQ({}, '1999-01-01T00:00:00', '2001-01-01T00:00:00')"
    assert rows(session.run("SELECT u._id, size(x.q) AS n FROM u INNER JOIN t AS x ON u._id = x._id WHERE " + wide.format("q"))) == [(1, 1), (2, 0), (3, 0)]
    assert rows(session.run("SELECT _id FROM u WHERE _id IN (SELECT y._id FROM t y WHERE " + wide.format("y.q") + " AND size(y.q) > 0)")) == [(1,)]
    assert len(rows(session.run("SELECT x._id, x.s1 FROM t x WITH (flatten(s1))"))) == 6
    assert len(rows(session.run("SELECT x._id, x.s1 FROM t WITH (flatten(s1)) AS x INNER JOIN u ON u._id = x._id"))) == 6


def test_casts(session) -> None:
    assert session.run("SELECT CAST('5000000000' AS INT) AS a, CAST(5 AS ID) AS b, CAST(1.55 AS DECIMAL(1)) AS c, CAST(0 AS BOOL) AS d").first()[:] == (5000000000, 5, Decimal("1.6"), False)


def test_percentile_is_the_bisection(session) -> None:
    session.run("CREATE TABLE p (_id id, i1 int, d1 decimal(2))")
    values = [10, 10, 11, 12, 12, 13]
    session.run("INSERT INTO p (_id, i1, d1) VALUES " + ", ".join(f"({k}, {v}, {v})" for k, v in enumerate(values)))
    assert session.run("SELECT percentile(i1, 50) AS a, count(*) AS n, percentile(d1, 50) AS b FROM p").first()[:] == (11, 6, Decimal("11.50"))
    assert session.run("SELECT percentile(i1, 50) AS a FROM p WHERE i1 < 13").first()[0] == 11
    assert session.run("SELECT percentile(i1, 50) AS a FROM p WHERE i1 > 99").first()[0] is None
    for bad in ("SELECT percentile(i1, 50) AS a FROM p GROUP BY d1", "SELECT _id FROM p WHERE i1 > percentile(i1, 5)", "SELECT percentile(i1 + 1, 5) AS x FROM p"):
        with pytest.raises(DialectError):
            session.run(bad)


@pytest.mark.parametrize("low", [-(2**62) - 3, -10, -9, 0, 5])
def test_middle_is_exact(low) -> None:
    for high in (low, low + 1, low + 7, 2**61 + 1):
        m = percentile.middle(low, high)
        assert low <= m <= high and abs(2 * m - low - high) <= 1
    assert percentile.middle(-3, 4) == 0 and percentile.middle(-4, 1) == -1


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM t RIGHT JOIN u ON t._id = u._id", "SELECT * FROM t FULL OUTER JOIN u ON t._id = u._id", "SELECT * FROM t JOIN u USING (_id)", "SELECT count(*) OVER (ORDER BY a) FROM t",
        "SELECT count(*) FILTER (WHERE a > 1) FROM t", "SELECT * FROM t WHERE EXISTS (SELECT 1 FROM u)", "SELECT a FROM t UNION SELECT a FROM u", "SELECT a FROM t EXCEPT SELECT a FROM u",
        "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT a FROM t LIMIT 3 OFFSET 2", "SELECT TOP(2) a FROM t LIMIT 3", "SELECT a + 1 FROM t GROUP BY a + 1", "SELECT a FROM t GROUP BY ROLLUP (a)",
        "SELECT a FROM t GROUP BY 1", "SELECT CAST(a AS IDSET) FROM t", "SELECT * FROM t WITH (nolock)", "SELECT (a FROM t",
    ],
)
def test_what_the_dialect_lacks(text) -> None:
    with pytest.raises(DialectError):
        to_spark(text)


def test_renames_and_drops(session, spark) -> None:
    for bad in ("_id TO x", "nothing TO x", "a TO b", "a TO _id"):
        with pytest.raises(DialectError):
            session.run(f"ALTER TABLE t RENAME COLUMN {bad}")
    session.run("DROP TABLE u")
    with pytest.raises(Exception):
        session.run("SELECT * FROM u")


def test_members_expire(session) -> None:
    session.expire("2030-01-02 12:00:00")
    assert {r[0]: [x["value"] for x in r[1]] for r in session.run("SELECT _id, q FROM t").collect()} == {1: [], 2: ["y"], 3: ["z"]}


def test_a_crash_leaves_the_last_catalogue(session, spark, tmp_path) -> None:
    """A half-written file of a crash is not read, and numbers go on."""
    (tmp_path / "store" / "_half.json").write_text("{")
    session.run("CREATE TABLE later (_id id, a int)")
    again = Session(spark, f"file://{tmp_path}/store")
    assert set(again.store.catalog["tables"]) == {"t", "u", "later"}
    assert len(list((tmp_path / "store").glob("catalog-*.json"))) == 2


def test_batches_are_known_by_number(session, spark) -> None:
    one = spark.createDataFrame([(9, 9)], "_id long, a long")
    session.store.write("u", one, ("s", 0))
    session.store.write("u", one.limit(0), ("s", 0))
    session.store.write("u", one.limit(0), ("other", 0))
    assert rows(session.run("SELECT * FROM u")) == []


def test_variables() -> None:
    assert parse("Row(a=$x)", {"x": [1]})[0].args == {"a": [1]}
    with pytest.raises(CallError):
        parse("Row(a=$x)")
