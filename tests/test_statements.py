"""Definitions, writes, loads, models and streams over a store."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from setwise.plans.calls import parse
from setwise.plans.statements import Session
from setwise.sources.files import header_fields
from setwise.streaming.ingest import ingest


@pytest.fixture
def session(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/store")
    s.run("CREATE TABLE t (_id id, i1 int min 0 max 1000, d1 decimal(2), s1 string, ids idset, q stringsetq timequantum 'YMD', ts timestamp)")
    s.run("INSERT INTO t (_id, i1, d1, s1, ids, q) VALUES (1, 10, 10.5, 'a', [1, 2], {'2022-01-02T03:00:00Z', ['x', 'y']}), (2, 20, 7, 'b', null, ['z'])")
    return s


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_insert_is_an_upsert(session) -> None:
    session.run("INSERT INTO t (_id, i1, ids, s1) VALUES (1, 11, [2, 3], null), (1, 12, [4], null), (3, 5, [9], 'c')")
    assert rows(session.run("SELECT _id, i1, s1 FROM t")) == [(1, 12, "a"), (2, 20, "b"), (3, 5, "c")]
    assert {r[0]: r[1] and sorted(r[1]) for r in session.run("SELECT _id, ids FROM t").collect()} == {1: [1, 2, 3, 4], 2: None, 3: [9]}
    for bad in ("INSERT INTO t (_id, i1) VALUES (4, 2000)", "INSERT INTO t (_id, i1) VALUES (-4, 2)", "INSERT INTO t (_id) VALUES (4)", "INSERT INTO t (_id, i1) VALUES (1)"):
        with pytest.raises(Exception):
            session.run(bad)


def test_time_ranges_narrow_members(session) -> None:
    got = session.run("SELECT _id, transform(q, x -> x.value) AS q FROM t WHERE RANGEQ(q, '2022-01-02T00:00:00', '2022-01-03T00:00:00')")
    assert {r[0]: sorted(r[1]) for r in got.collect()} == {1: ["x", "y"], 2: []}


def test_alter_view_copy_delete_show(session) -> None:
    session.run("ALTER TABLE t ADD COLUMN b1 bool")
    session.run("ALTER TABLE t RENAME COLUMN s1 TO name")
    session.run("ALTER TABLE t DROP COLUMN ids")
    assert session.run("SHOW COLUMNS FROM t").count() == 7
    session.run("CREATE VIEW v AS SELECT _id, name FROM t WHERE i1 > 15")
    assert rows(session.run("SELECT * FROM v")) == [(2, "b")]
    session.run("ALTER VIEW v AS SELECT _id FROM t")
    assert rows(session.run("SELECT * FROM v")) == [(1,), (2,)]
    session.run("COPY t TO u WHERE i1 = 10")
    assert rows(session.run("SELECT _id FROM u")) == [(1,)]
    session.run("DELETE FROM t WHERE i1 = 10")
    assert rows(session.run("SELECT _id FROM t")) == [(2,)]
    session.run("DELETE FROM t")
    assert rows(session.run("SELECT _id FROM t")) == []
    assert "i1 int min 0 max 1000" in session.run("SHOW CREATE TABLE t").first()[0]
    session.run("DROP VIEW v")
    session.run("DROP TABLE t")
    assert rows(session.run("SHOW TABLES")) == [("u", "")]
    with pytest.raises(Exception):
        session.run("UPDATE u SET i1 = 1")


def test_bulk_loads(session, spark, tmp_path) -> None:
    session.run("BULK INSERT INTO t (_id, i1, s1, ids) MAP (0 id, 1 int, 2 string, 3 int) TRANSFORM (@0, @1 + 1, @2, [@3]) FROM '7,1,x,3\n8,2,y,4' WITH FORMAT 'CSV' INPUT 'STREAM'")
    assert [x for x in rows(session.run("SELECT _id, i1, s1 FROM t")) if x[0] > 6] == [(7, 2, "x"), (8, 3, "y")]
    f = tmp_path / "in.ndjson"
    f.write_text('{"k": 9, "a": {"b": "deep"}, "s": [1, 2], "t": 86400}\n')
    session.run(f"BULK INSERT INTO t (_id, s1, ids, ts) MAP ('$.k' id, '$.a.b' string, '$.s' idset, '$.t' timestamp) FROM '{f}' WITH FORMAT 'NDJSON' INPUT 'FILE'")
    r = session.run("SELECT s1, ids, ts FROM t WHERE _id = 9").first()
    assert r[0] == "deep" and sorted(r[1]) == [1, 2] and r[2] == dt.datetime(1970, 1, 2)
    spark.range(20, 23).selectExpr("id AS key", "'p' AS s").write.parquet(str(tmp_path / "p"))
    session.run(f"BULK INSERT INTO t (_id, s1) MAP ('key' id, 's' string) FROM '{tmp_path}/p' WITH FORMAT 'PARQUET' INPUT 'FILE'")
    assert session.run("SELECT _id FROM t WHERE s1 = 'p'").count() == 3


def test_models_truncate(session) -> None:
    session.run("CREATE TABLE m (_id id, x int, y int)")
    session.run("INSERT INTO m VALUES " + ", ".join(f"({k}, {k}, {3 * k + 2})" for k in range(1, 9)))
    session.run("CREATE MODEL lin WITH (modeltype 'linear_regression', labels ['y']) AS SELECT _id, x, y FROM m")
    got = session.run("PREDICT USING lin SELECT _id, x FROM m WHERE x = 4").first()
    assert abs(got["prediction"] - Decimal("14")) <= Decimal("0.0001")
    session.run("DROP MODEL lin")
    with pytest.raises(ValueError):
        session.run("PREDICT USING lin SELECT _id, x FROM m")


def test_stream_batches_are_idempotent(session, spark, tmp_path) -> None:
    src = tmp_path / "src"
    for k in range(2):
        spark.createDataFrame([(k + 50, k), (1, 100 + k)], "_id long, i1 long").coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema("_id long, i1 long").option("maxFilesPerTrigger", 1).json(str(src))
    for _ in range(2):
        ingest(stream, session.store, "t", f"file://{tmp_path}/ck").awaitTermination()
    got = dict(rows(session.run("SELECT _id, i1 FROM t")))
    assert got[50] == 0 and got[51] == 1 and got[1] in (100, 101) and len(got) == 4
    before = session.store.meta("t")["path"]
    session.store.write("t", session.store.read("t"), (f"file://{tmp_path}/ck", 0))
    assert session.store.meta("t")["path"] == before


def test_headers_and_calls() -> None:
    assert header_fields(["a___id__ID", "price__Decimal_2", "x__Ignore"]) == [{"source": "a", "name": "id", "type": "id"}, {"source": "price", "name": "price", "type": "decimal", "scale": 2}, {"source": "x", "name": "x", "type": None}]
    assert parse("Count(Row(a=1))")[0].name == "count"
    with pytest.raises(ValueError):
        parse("Count(Row(a=1)")
