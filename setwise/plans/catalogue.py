"""Registered queries over the reference tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.operators import arrays
from setwise.plans import dialect
from setwise.plans.calls import parse
from setwise.plans.samples import WITH, engine, index_table, read, views
from setwise.plans.statements import Session
from setwise.sources.store import shared_folder
from setwise.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Query, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle if oracle.startswith("WITH") else WITH + oracle


def call(name: str, index: str, text: str, oracle: str | None, *columns: str) -> None:
    """A query in the call language; columns are SQL expressions of its result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = engine(spark, sf_dir).query(index, text)
        return out.selectExpr(*columns) if columns else out

    add(name, run, oracle)


def sql(name: str, text: str, oracle: str | None = None, quantums: dict[str, str] | None = None) -> None:
    """A query in the SQL dialect; the same text is the oracle's unless the dialect differs from SQL there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return dialect.select(spark, text, quantums)

    add(name, run, oracle or text)


# sets of records

call("pql_row_eq", "orders", "Row(status='F')", "SELECT _id FROM t_orders WHERE status = 'F'")
call("pql_row_bsi", "orders", "Row(cents > 90)", "SELECT _id FROM t_orders WHERE cents > 90")
call("pql_row_bsi_ne", "orders", "Row(cents != 5)", "SELECT _id FROM t_orders WHERE cents <> 5")
call("pql_row_decimal", "parts", "Row(price <= 905.5)", "SELECT _id FROM t_parts WHERE price <= 905.5")
call("pql_row_timestamp", "orders", "Row(orderdate >= '1997-01-01T00:00')", "SELECT _id FROM t_orders WHERE orderdate >= TIMESTAMP '1997-01-01'")
call("pql_row_between", "parts", "Row(size >< [10, 20])", "SELECT _id FROM t_parts WHERE size BETWEEN 10 AND 20")
call("pql_row_between_open", "parts", "Row(10 < size <= 20)", "SELECT _id FROM t_parts WHERE size > 10 AND size <= 20")
call("pql_row_null", "customers", "Row(priorities == null)", "SELECT _id FROM t_customers WHERE _id NOT IN (SELECT _id FROM members)")
call("pql_row_not_null", "customers", "Row(priorities != null)", "SELECT _id FROM t_customers WHERE _id IN (SELECT _id FROM members)")
call("pql_row_set", "customers", "Row(priorities='1-URGENT')", "SELECT _id FROM members WHERE v = '1-URGENT'")
call("pql_row_time", "users", "Row(types='click', from='2024-01-05T10:00', to='2024-01-07T00:00')", "SELECT DISTINCT _id FROM hits WHERE v = 'click' AND date_trunc('hour', ts) >= TIMESTAMP '2024-01-05 10:00:00' AND date_trunc('hour', ts) < TIMESTAMP '2024-01-07'")
call("pql_row_time_all", "users", "Row(types='click')", "SELECT DISTINCT _id FROM hits WHERE v = 'click'")
call("pql_range", "orders", "Range(cents < 7)", "SELECT _id FROM t_orders WHERE cents < 7")
call("pql_bitmap", "orders", "Bitmap(status='O')", "SELECT _id FROM t_orders WHERE status = 'O'")
call("pql_union", "orders", "Union(Row(status='F'), Row(cents=3), Row(cents=4))", "SELECT _id FROM t_orders WHERE status = 'F' OR cents IN (3, 4)")
call("pql_union_empty", "orders", "Union()", "SELECT _id FROM t_orders WHERE 1 = 0")
call("pql_intersect", "orders", "Intersect(Row(status='F'), Row(cents > 50))", "SELECT _id FROM t_orders WHERE status = 'F' AND cents > 50")
call("pql_difference", "orders", "Difference(Row(status='F'), Row(cents > 50), Row(priority='5-LOW'))", "SELECT _id FROM t_orders WHERE status = 'F' AND NOT cents > 50 AND priority <> '5-LOW'")
call("pql_xor", "orders", "Xor(Row(status='F'), Row(cents > 50))", "SELECT _id FROM t_orders WHERE (status = 'F') <> (cents > 50)")
call("pql_not", "customers", "Not(Row(priorities='1-URGENT'))", "SELECT _id FROM t_customers WHERE _id NOT IN (SELECT _id FROM members WHERE v = '1-URGENT')")
call("pql_all", "parts", "All()", "SELECT _id FROM t_parts")
call("pql_all_limit", "parts", "All(limit=10, offset=5)", "SELECT _id FROM t_parts ORDER BY _id LIMIT 10 OFFSET 5")
call("pql_constrow", "parts", "ConstRow(columns=[1, 2, 3, 99999999])", "SELECT _id FROM t_parts WHERE _id IN (1, 2, 3, 99999999)")
call("pql_limit", "orders", "Limit(Row(status='P'), limit=20, offset=10)", "SELECT _id FROM t_orders WHERE status = 'P' ORDER BY _id LIMIT 20 OFFSET 10")
call("pql_shift", "orders", "Shift(Row(cents=9), n=1)", "SELECT _id FROM t_orders WHERE _id IN (SELECT _id + 1 FROM t_orders WHERE cents = 9)")
call("pql_unionrows", "customers", "UnionRows(Rows(priorities, like='1%'))", "SELECT DISTINCT _id FROM members WHERE v LIKE '1%'")
call("pql_unionrows_topn", "orders", "UnionRows(TopN(priority, n=1))", "SELECT _id FROM t_orders WHERE priority = (SELECT priority FROM t_orders GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)")
call("pql_innerunionrows", "customers", "InnerUnionRows(field=priorities, rows=['1-URGENT', '2-HIGH'])", "SELECT DISTINCT _id FROM members WHERE v IN ('1-URGENT', '2-HIGH')")
call("pql_distinct", "orders", "Distinct(Row(status='P'), field=cents)", "SELECT DISTINCT cents AS value FROM t_orders WHERE status = 'P'")
call("pql_distinct_set", "customers", "Distinct(field=priorities)", "SELECT DISTINCT v AS value FROM members")
call("pql_cross_index", "customers", "Intersect(Row(segment='BUILDING'), Distinct(Row(status='P'), index=orders, field=custkey))", "SELECT _id FROM t_customers WHERE segment = 'BUILDING' AND _id IN (SELECT custkey FROM t_orders WHERE status = 'P')")
call("pql_sort", "parts", "Sort(Row(size > 10), field=price, limit=25, offset=5, sort-desc=true)", "SELECT _id, price AS value FROM t_parts WHERE size > 10 ORDER BY price DESC, _id LIMIT 25 OFFSET 5")

# aggregates and lookups

call("pql_count", "orders", "Count(Intersect(Row(status='F'), Row(cents > 50)))", "SELECT count(*) AS count FROM t_orders WHERE status = 'F' AND cents > 50")
call("pql_count_distinct", "orders", "Count(Distinct(field=custkey))", "SELECT count(DISTINCT custkey) AS count FROM t_orders")
call("pql_sum", "orders", "Sum(Row(status='F'), field=price)", "SELECT CAST(coalesce(sum(price), 0) AS DECIMAL(38,2)) AS value, count(price) AS count FROM t_orders WHERE status = 'F'", "CAST(value AS DECIMAL(38,2)) AS value", "count")
call("pql_sum_empty", "orders", "Sum(Row(status='none'), field=cents)", "SELECT CAST(0 AS BIGINT) AS value, CAST(0 AS BIGINT) AS count")
call("pql_min", "orders", "Min(Row(status='F'), field=cents)", "SELECT cents AS value, count(*) AS count FROM t_orders WHERE status = 'F' AND cents = (SELECT min(cents) FROM t_orders WHERE status = 'F') GROUP BY cents")
call("pql_max", "parts", "Max(field=size)", "SELECT size AS value, count(*) AS count FROM t_parts WHERE size = (SELECT max(size) FROM t_parts) GROUP BY size")
call("pql_minrow", "customers", "MinRow(field=priorities)", "SELECT v AS value, count(*) AS count FROM members GROUP BY v ORDER BY v LIMIT 1")
call("pql_maxrow", "customers", "MaxRow(Row(segment='BUILDING'), field=priorities)", "SELECT v AS value, count(*) AS count FROM members JOIN t_customers USING (_id) WHERE segment = 'BUILDING' GROUP BY v ORDER BY v DESC LIMIT 1")
call("pql_percentile", "orders", "Percentile(field=cents, nth=0, filter=Row(status='F'))", "SELECT min(cents) AS value, count(*) AS count FROM t_orders WHERE status = 'F'")
call("pql_percentile_max", "parts", "Percentile(field=price, nth=100)", "SELECT max(price) AS value, count(*) AS count FROM t_parts")
# the bisection may end at a value that no record has, which SQL can't tell
call("pql_percentile_50", "orders", "Percentile(field=cents, nth=50, filter=Row(status='F'))", None)
call("pql_percentile_99", "parts", "Percentile(field=price, nth=99)", None)
call("pql_topn", "customers", "TopN(priorities, n=2)", "SELECT v AS value, count(*) AS count FROM members GROUP BY v ORDER BY count DESC, v LIMIT 2")
call("pql_topn_source", "orders", "TopN(priority, Row(status='F'), n=3, threshold=5)", "SELECT priority AS value, count(*) AS count FROM t_orders WHERE status = 'F' GROUP BY priority HAVING count(*) >= 5 ORDER BY count DESC, value LIMIT 3")
call("pql_topn_ids", "orders", "TopN(priority, ids=['1-URGENT', '5-LOW'])", "SELECT priority AS value, count(*) AS count FROM t_orders WHERE priority IN ('1-URGENT', '5-LOW') GROUP BY priority")
call("pql_topn_tanimoto", "orders", "TopN(priority, Row(status='F'), tanimotoThreshold=14)", "SELECT priority AS value, count(*) FILTER (WHERE status = 'F') AS count FROM t_orders GROUP BY priority HAVING ceil(100.0 * count(*) FILTER (WHERE status = 'F') / (count(*) + (SELECT count(*) FROM t_orders WHERE status = 'F') - count(*) FILTER (WHERE status = 'F'))) > 14 AND count(*) FILTER (WHERE status = 'F') > 0")
call("pql_topk", "orders", "TopK(priority, k=3, filter=Row(cents > 10))", "SELECT priority AS value, count(*) AS count FROM t_orders WHERE cents > 10 GROUP BY priority ORDER BY count DESC, value LIMIT 3")
call("pql_topk_time", "users", "TopK(types, k=3, from='2024-01-10T00:00', to='2024-01-12T00:00')", "SELECT v AS value, count(DISTINCT _id) AS count FROM hits WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY v ORDER BY count DESC, value LIMIT 3")
call("pql_rows", "orders", "Rows(priority, limit=3)", "SELECT DISTINCT priority AS value FROM t_orders ORDER BY value LIMIT 3")
call("pql_rows_previous", "orders", "Rows(priority, previous='2-HIGH')", "SELECT DISTINCT priority AS value FROM t_orders WHERE priority > '2-HIGH'")
call("pql_rows_like", "parts", "Rows(name, like='%r_d%')", "SELECT DISTINCT name AS value FROM t_parts WHERE name LIKE '%r_d%'")
call("pql_rows_in", "parts", "Rows(type, in=['SMALL', 'none'])", "SELECT DISTINCT type AS value FROM t_parts WHERE type IN ('SMALL', 'none')")
call("pql_rows_column", "customers", "Rows(priorities, column=7)", "SELECT v AS value FROM members WHERE _id = 7")
call("pql_groupby", "orders", "GroupBy(Rows(status), Rows(priority), filter=Row(cents > 20))", "SELECT status, priority, count(*) AS count FROM t_orders WHERE cents > 20 GROUP BY status, priority")
call("pql_groupby_sum_having", "orders", "GroupBy(Rows(status), Rows(priority), aggregate=Sum(field=cents), having=Condition(count > 10), sort='count desc, sum asc')", "SELECT status, priority, count(cents) AS count, CAST(sum(cents) AS BIGINT) AS sum FROM t_orders GROUP BY status, priority HAVING count(cents) > 10")
call("pql_groupby_having_between", "orders", "GroupBy(Rows(cents), having=Condition(5 < count <= 160))", "SELECT cents, count(*) AS count FROM t_orders GROUP BY cents HAVING count(*) > 5 AND count(*) <= 160")
call("pql_groupby_sets", "customers", "GroupBy(Rows(segment), Rows(priorities), aggregate=Sum(field=nation))", "SELECT segment, v AS priorities, count(*) AS count, CAST(sum(nation) AS BIGINT) AS sum FROM t_customers JOIN members USING (_id) GROUP BY segment, v")
call("pql_groupby_distinct", "orders", "GroupBy(Rows(status), aggregate=Count(Distinct(field=custkey)))", "SELECT status, count(*) AS count, count(DISTINCT custkey) AS agg FROM t_orders GROUP BY status")
call("pql_groupby_limit", "orders", "GroupBy(Rows(priority), Rows(status), limit=4, offset=2)", "SELECT priority, status, count(*) AS count FROM t_orders GROUP BY priority, status ORDER BY priority, status LIMIT 4 OFFSET 2")
call("pql_includescolumn", "orders", "IncludesColumn(Row(status='F'), column=3)", "SELECT count(*) > 0 AS included FROM t_orders WHERE status = 'F' AND _id = 3")
call("pql_fieldvalue", "parts", "FieldValue(field=size, column=17)", "SELECT size AS value FROM t_parts WHERE _id = 17")
call("pql_extract", "orders", "Extract(Row(cents=42), Rows(status), Rows(price))", "SELECT _id, status, price FROM t_orders WHERE cents = 42")
call("pql_extract_sort", "orders", "Extract(Sort(Row(cents=42), field=price, limit=7), Rows(status), Rows(price))", "SELECT _id, status, price FROM t_orders WHERE cents = 42 ORDER BY price, _id LIMIT 7")
call("pql_extract_time", "users", "Extract(All(), Rows(types, from='2024-01-10T00:00', to='2024-01-10T06:00'))", "SELECT u._id, coalesce(string_agg(DISTINCT h.v, ',' ORDER BY h.v), '') AS types FROM (SELECT DISTINCT _id FROM hits) u LEFT JOIN hits h ON h._id = u._id AND h.ts >= TIMESTAMP '2024-01-10' AND h.ts < TIMESTAMP '2024-01-10 06:00:00' GROUP BY u._id", "_id", "array_join(array_sort(types), ',') AS types")
call("pql_options_shards", "orders", "Options(Count(Row(status='F')), shards=[0])", "SELECT count(*) AS count FROM t_orders WHERE status = 'F' AND _id < 1048576")

# writes: the table afterwards

call("pql_set", "orders", "Set(3, status='X')", "SELECT _id, CASE WHEN _id = 3 THEN 'X' ELSE status END AS status FROM t_orders", "_id", "status")
call("pql_set_new", "customers", "Set(99000001, priorities='9-NEW') Count(All())", "SELECT count(*) + 1 AS count FROM t_customers")
call("pql_set_member", "customers", "Set(7, priorities='0-TOP') Rows(priorities, column=7)", "SELECT v AS value FROM members WHERE _id = 7 UNION SELECT '0-TOP'")
call("pql_set_time", "users", "Set(7, types='late', '2030-01-01T05:00') Row(types='late', from='2030-01-01T05:00', to='2030-01-01T06:00')", "SELECT CAST(7 AS BIGINT) AS _id")
call("pql_clear", "customers", "Clear(7, segment='BUILDING')", "SELECT _id, CASE WHEN _id = 7 AND segment = 'BUILDING' THEN NULL ELSE segment END AS segment FROM t_customers", "_id", "segment")
call("pql_clearrow", "customers", "ClearRow(priorities='1-URGENT') Count(Row(priorities='1-URGENT'))", "SELECT CAST(0 AS BIGINT) AS count")
call("pql_store", "orders", "Store(Row(cents > 95), status='HIGH') GroupBy(Rows(status))", "SELECT CASE WHEN cents > 95 THEN 'HIGH' ELSE status END AS status, count(*) AS count FROM t_orders GROUP BY 1")
call("pql_delete", "orders", "Delete(Row(status='F')) Count(All())", "SELECT count(*) AS count FROM t_orders WHERE status <> 'F'")

# the array side

add("apply_expression", lambda s, d: arrays.apply_program(engine(s, d), "parts", parse("Row(size > 40)")[0], "size * 2 + 1"), "SELECT _id, size * 2 + 1 AS value FROM t_parts WHERE size > 40")
add("apply_reduce", lambda s, d: arrays.apply_program(engine(s, d), "parts", None, "+/ size * size"), "SELECT CAST(sum(size * size) AS BIGINT) AS value FROM t_parts")
call("pql_apply", "parts", "Apply(Row(size > 40), 'size * 2 + 1')", "SELECT _id, size * 2 + 1 AS value FROM t_parts WHERE size > 40")
call("pql_apply_reduce", "parts", "Apply('size * size', '+/ _')", "SELECT CAST(sum(size * size) AS BIGINT) AS value FROM t_parts")
call("pql_arrow", "parts", "Arrow(Row(size=5), header=['name', 'size'])", "SELECT _id, name, size FROM t_parts WHERE size = 5")
QUERIES["pql_variables"] = lambda s, d: engine(s, d).query("parts", "Intersect(Row(size > $least), Row(brand=$brand))", {"least": 20, "brand": "Brand#11"})
SQL["pql_variables"] = WITH + "SELECT _id FROM t_parts WHERE size > 20 AND brand = 'Brand#11'"
add("arrow_fetch", lambda s, d: arrays.arrow(engine(s, d), "parts", parse("Row(size=5)")[0], ["name", "size"]), "SELECT _id, name, size FROM t_parts WHERE size = 5")

# SQL: relations

sql("sql_filter_project", "SELECT _id, price, cents FROM t_orders WHERE status = 'F' AND cents >= 30")
sql("sql_null_table", "SELECT 1 + 2 AS x, 'a' || 'b' AS y", "SELECT 3 AS x, 'ab' AS y")
sql("sql_inner_join", "SELECT o._id, c.name, o.cents FROM t_orders o INNER JOIN t_customers c ON o.custkey = c._id WHERE c.segment = 'BUILDING'")
sql("sql_left_join", "SELECT c._id, o._id AS orderid FROM t_customers c LEFT JOIN t_orders o ON o.custkey = c._id AND o.cents = 1")
sql("sql_comma_join", "SELECT c._id, o._id AS orderid FROM t_customers c, t_orders o WHERE o.custkey = c._id AND o.cents = 2")
sql("sql_theta_join", "SELECT p._id AS a, q._id AS b FROM t_parts p INNER JOIN t_parts q ON p.size = q.size AND p.price < q.price")
sql("sql_three_way_join", "SELECT n.n_name AS nation, count(*) AS n, sum(o.cents) AS total FROM t_orders o INNER JOIN t_customers c ON o.custkey = c._id INNER JOIN nation n ON n.n_nationkey = c.nation GROUP BY n.n_name", "SELECT n.n_name AS nation, count(*) AS n, CAST(sum(o.cents) AS BIGINT) AS total FROM t_orders o JOIN t_customers c ON o.custkey = c._id JOIN nation n ON n.n_nationkey = c.nation GROUP BY n.n_name")
sql("sql_in_subquery", "SELECT _id FROM t_customers WHERE _id IN (SELECT custkey FROM t_orders WHERE cents = 7)")
sql("sql_not_in_subquery", "SELECT _id FROM t_customers WHERE _id NOT IN (SELECT custkey FROM t_orders WHERE cents < 60)")
sql("sql_scalar_subquery", "SELECT _id FROM t_parts WHERE size = (SELECT max(size) FROM t_parts)")
sql("sql_derived_table", "SELECT status, n FROM (SELECT status, count(*) AS n FROM t_orders GROUP BY status) AS x WHERE n > 1")
sql("sql_group_by_having", "SELECT status, priority, count(*) AS n, sum(cents) AS total, min(price) AS low, max(price) AS high FROM t_orders GROUP BY status, priority HAVING count(*) > 3", "SELECT status, priority, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, min(price) AS low, max(price) AS high FROM t_orders GROUP BY status, priority HAVING count(*) > 3")
sql("sql_distinct", "SELECT DISTINCT status, priority FROM t_orders")
sql("sql_order_top", "SELECT TOP(12) _id, price FROM t_orders ORDER BY price DESC, _id", "SELECT _id, price FROM t_orders ORDER BY price DESC, _id LIMIT 12")
sql("sql_order_limit", "SELECT _id, status FROM t_orders ORDER BY status, _id DESC LIMIT 9")
sql("sql_top_subquery", "SELECT _id FROM t_parts WHERE _id IN (SELECT TOP(7) _id FROM t_parts ORDER BY price DESC, _id) AND size > 0", "SELECT _id FROM (SELECT _id, size FROM t_parts ORDER BY price DESC, _id LIMIT 7) WHERE size > 0")
sql("sql_top_derived", "SELECT o._id, x.name FROM t_orders o INNER JOIN (SELECT TOP(3) _id, name FROM t_customers ORDER BY _id) AS x ON o.custkey = x._id", "SELECT o._id, x.name FROM t_orders o JOIN (SELECT _id, name FROM t_customers ORDER BY _id LIMIT 3) x ON o.custkey = x._id")
sql("sql_flatten_alias", "SELECT array_join(c.priorities, '') AS p, count(*) AS n FROM t_customers c WITH (flatten(priorities)) INNER JOIN nation k ON k.n_nationkey = c.nation GROUP BY c.priorities", "SELECT v AS p, count(*) AS n FROM t_customers JOIN members USING (_id) GROUP BY v")
sql("sql_rangeq_alias", "SELECT p._id, size(u.types) AS n FROM t_parts AS p INNER JOIN t_users AS u ON u._id = p._id WHERE RANGEQ(u.types, '2024-01-05T00:00:00', '2024-01-06T00:00:00')", "SELECT u._id, CAST(count(h.v) AS INTEGER) AS n FROM (SELECT DISTINCT _id FROM hits WHERE _id IN (SELECT _id FROM t_parts)) u LEFT JOIN (SELECT DISTINCT * FROM hits) h ON h._id = u._id AND h.ts >= TIMESTAMP '2024-01-05' AND h.ts < TIMESTAMP '2024-01-06' GROUP BY u._id", {"types": "YMDH"})
sql("sql_percentile", "SELECT percentile(cents, 0) AS low, count(*) AS n, percentile(cents, 100) AS high FROM t_orders WHERE status = 'F'", "SELECT min(cents) AS low, count(*) AS n, max(cents) AS high FROM t_orders WHERE status = 'F'")
sql("sql_flatten_group_by", "SELECT array_join(priorities, '') AS p, count(*) AS n, sum(nation) AS s FROM t_customers WITH (flatten(priorities)) GROUP BY priorities", "SELECT v AS p, count(*) AS n, CAST(sum(nation) AS BIGINT) AS s FROM t_customers JOIN members USING (_id) GROUP BY v")
sql("sql_flatten_distinct", "SELECT DISTINCT array_join(priorities, '') AS p FROM t_customers WITH (flatten(priorities))", "SELECT DISTINCT v AS p FROM members")
sql("sql_rangeq", "SELECT _id, size(types) AS n FROM t_users WHERE RANGEQ(types, '2024-01-05T00:00:00', '2024-01-06T00:00:00')", "SELECT u._id, CAST(count(h.v) AS INTEGER) AS n FROM (SELECT DISTINCT _id FROM hits) u LEFT JOIN (SELECT DISTINCT * FROM hits) h ON h._id = u._id AND h.ts >= TIMESTAMP '2024-01-05' AND h.ts < TIMESTAMP '2024-01-06' GROUP BY u._id", {"types": "YMDH"})

# SQL: aggregates

sql("agg_count", "SELECT count(*) AS n, count(priorities) AS sets, count(DISTINCT segment) AS d FROM t_customers", "SELECT count(*) AS n, (SELECT count(DISTINCT _id) FROM members) AS sets, count(DISTINCT segment) AS d FROM t_customers")
sql("agg_sum", "SELECT flag, sum(quantity) AS q, CAST(sum(price) AS DECIMAL(38,2)) AS p FROM t_lines GROUP BY flag", "SELECT flag, CAST(sum(quantity) AS BIGINT) AS q, CAST(sum(price) AS DECIMAL(38,2)) AS p FROM t_lines GROUP BY flag")
sql("agg_avg", "SELECT flag, CAST(avg(price) AS DECIMAL(18,4)) AS a FROM t_lines GROUP BY flag", "SELECT flag, (CAST(sum(price) * 100 AS HUGEINT) * 100 // count(price))::DECIMAL(38,0) * CAST(0.0001 AS DECIMAL(5,4)) AS a FROM t_lines GROUP BY flag")
sql("agg_min_max", "SELECT linestatus, min(price) AS low, max(shipdate) AS last, min(flag) AS f FROM t_lines GROUP BY linestatus")
sql("agg_var", "SELECT CAST(var(quantity) AS DOUBLE) AS v FROM t_lines", "SELECT floor(var_pop(quantity) * 1000000) / 1000000 AS v FROM t_lines")
sql("agg_corr", "SELECT flag, CAST(corr(quantity, price) AS DOUBLE) AS c FROM t_lines GROUP BY flag", "SELECT flag, trunc(corr(quantity, price) * 1000000) / 1000000 AS c FROM t_lines GROUP BY flag")

# SQL: predicates and operators

sql("op_and_or", "SELECT _id FROM t_orders WHERE (status = 'F' OR cents > 90) AND priority <> '5-LOW'")
sql("op_comparison", "SELECT _id FROM t_parts WHERE size <> 5 AND size != 6 AND price >= 901.1 AND size <= 30 AND size > 2 AND price < 1000")
sql("op_arithmetic", "SELECT _id, size + 2 AS a, size - 3 AS b, size * 4 AS c, size / 7 AS d, size % 7 AS e, -size AS f FROM t_parts", "SELECT _id, size + 2 AS a, size - 3 AS b, size * 4 AS c, size // 7 AS d, size % 7 AS e, -size AS f FROM t_parts")
sql("op_int_division", "SELECT _id, size / 7 AS a, (size - 25) / 4 AS b, -size / 3 * 2 AS c, sum(size) / count(*) AS d FROM t_parts GROUP BY _id, size", "SELECT _id, size // 7 AS a, CAST(trunc((size - 25) / 4) AS BIGINT) AS b, CAST(trunc(-size / 3) AS BIGINT) * 2 AS c, size AS d FROM t_parts")
sql("op_decimal_division", "SELECT _id, CAST(price / 7 AS DECIMAL(18,2)) AS a FROM t_parts", "SELECT _id, CAST((CAST(price * 100 AS BIGINT) // 7) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS a FROM t_parts")
sql("op_set_compare", "SELECT a._id, b._id AS other FROM t_customers a INNER JOIN t_customers b ON a.nation = b.nation AND a.segment = b.segment AND a._id < b._id WHERE a.priorities = b.priorities AND a.priorities != ['1-URGENT']", "SELECT a._id, b._id AS other FROM t_customers a JOIN t_customers b ON a.nation = b.nation AND a.segment = b.segment AND a._id < b._id JOIN (SELECT _id, list(DISTINCT v) AS p FROM members GROUP BY _id) x ON x._id = a._id JOIN (SELECT _id, list(DISTINCT v) AS p FROM members GROUP BY _id) y ON y._id = b._id WHERE list_has_all(x.p, y.p) AND NOT list_contains(x.p, '1-URGENT')")
sql("op_cast_whole", "SELECT _id, CAST('5000000000' AS INT) AS a, CAST(size AS ID) AS b, CAST(price AS DECIMAL(1)) AS c, CAST(size > 9 AS INT) AS d, CAST(price AS STRING) AS e FROM t_parts", "SELECT _id, 5000000000 AS a, size AS b, CAST(price AS DECIMAL(38,1)) AS c, CAST(size > 9 AS BIGINT) AS d, CAST(price AS VARCHAR) AS e FROM t_parts")
sql("op_bitwise", "SELECT _id, size & 6 AS a, size | 9 AS b, ~size AS c, size << 2 AS d, size >> 1 AS e FROM t_parts")
sql("op_concat", "SELECT _id, brand || '-' || type AS x FROM t_parts")
sql("op_like", "SELECT _id FROM t_parts WHERE name LIKE 'RED%'", "SELECT _id FROM t_parts WHERE name ILIKE 'red%'")
sql("op_not_like", "SELECT _id FROM t_parts WHERE name NOT LIKE '%r_d%'", "SELECT _id FROM t_parts WHERE NOT regexp_matches(name, '(?i)^.*r.+d.*$')")
sql("op_is_null", "SELECT _id FROM t_customers WHERE priorities IS NULL", "SELECT _id FROM t_customers WHERE _id NOT IN (SELECT _id FROM members)")
sql("op_between", "SELECT _id FROM t_orders WHERE orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01' AND cents NOT BETWEEN 10 AND 80")
sql("op_in", "SELECT _id FROM t_orders WHERE status IN ('F', 'P') AND cents NOT IN (1, 2, 3)")
sql("op_case", "SELECT _id, CASE WHEN size < 10 THEN 'small' WHEN size < 30 THEN 'medium' ELSE 'large' END AS s, CASE size WHEN 1 THEN 10 ELSE 20 END AS t FROM t_parts")
sql("op_cast", "SELECT _id, CAST(size AS STRING) AS a, CAST(size AS DECIMAL(18,2)) AS b, CAST(price AS STRING) AS c, CAST('12' AS BIGINT) AS d, CAST(size > 4 AS STRING) AS e FROM t_parts")
sql("op_set_literal", "SELECT _id FROM t_customers WHERE SETCONTAINSALL(priorities, ['1-URGENT', '2-HIGH'])", "SELECT _id FROM members WHERE v IN ('1-URGENT', '2-HIGH') GROUP BY _id HAVING count(*) = 2")
sql("op_set_equals", "SELECT _id FROM t_customers WHERE priorities = ['1-URGENT']", "SELECT _id FROM members WHERE v = '1-URGENT'")
sql("fn_setcontains", "SELECT _id FROM t_customers WHERE SETCONTAINS(priorities, '2-HIGH')", "SELECT _id FROM members WHERE v = '2-HIGH'")
sql("fn_setcontainsany", "SELECT _id FROM t_customers WHERE SETCONTAINSANY(priorities, ['2-HIGH', 'x'])", "SELECT _id FROM members WHERE v = '2-HIGH'")

# SQL: scalar functions


def fn(name: str, expression: str, oracle: str, table: str = "t_parts") -> None:
    sql(f"fn_{name}", f"SELECT _id, {expression} AS x FROM {table}", f"SELECT _id, {oracle} AS x FROM {table}")


fn("reverse", "REVERSE(name)", "reverse(name)")
fn("lower", "LOWER(brand)", "lower(brand)")
fn("upper", "UPPER(name)", "upper(name)")
fn("char", "CHAR(65 + size % 26)", "chr(CAST(65 + size % 26 AS INTEGER))")
fn("ascii", "ASCII(SUBSTRING(name, 1, 1))", "ascii(substr(name, 2, 1))")
fn("substring", "SUBSTRING(name, 2, 3)", "substr(name, 3, 3)")
fn("substring_rest", "SUBSTRING(name, 2)", "substr(name, 3)")
fn("replaceall", "REPLACEALL(name, 'e', 'xx')", "replace(name, 'e', 'xx')")
fn("stringsplit", "STRINGSPLIT(name, ' ', 1)", "coalesce(string_split(name, ' ')[2], '')")
fn("trim", "TRIM('  ' || name || '  ')", "trim('  ' || name || '  ')")
fn("ltrim", "LTRIM('  ' || name || ' ')", "ltrim('  ' || name || ' ')")
fn("rtrim", "RTRIM('  ' || name || ' ')", "rtrim('  ' || name || ' ')")
fn("prefix", "PREFIX(name, 4)", "left(name, 4)")
fn("suffix", "SUFFIX(name, 4)", "right(name, 4)")
fn("space", "name || SPACE(3) || type", "name || '   ' || type")
fn("len", "LEN(name)", "CAST(length(name) AS INTEGER)")
fn("replicate", "REPLICATE(type, 2)", "repeat(type, 2)")
fn("format", "FORMAT('%s has %d', name, size)", "name || ' has ' || size")
fn("charindex", "CHARINDEX('e', name)", "CAST(instr(name, 'e') - 1 AS INTEGER)")
fn("charindex_from", "CHARINDEX('e', name, 3)", "CAST(CASE WHEN instr(substr(name, 4), 'e') > 0 THEN instr(substr(name, 4), 'e') + 2 ELSE -1 END AS INTEGER)")
fn("str", "STR(size, 6, 2)", "lpad(printf('%.2f', CAST(size AS DOUBLE)), 6, ' ')")
PARTS_OF_TIME = {"YY": "year", "YD": "dayofyear", "M": "month", "D": "day", "W": "dayofweek", "WK": "week", "HH": "hour", "MI": "minute", "S": "second"}
for short, long in PARTS_OF_TIME.items():
    fn(f"datetimepart_{short.lower()}", f"DATETIMEPART('{short}', orderdate)", f"CAST({long}(orderdate) AS BIGINT)", "t_orders")
fn("datetimename_month", "DATETIMENAME('M', orderdate)", "monthname(orderdate)", "t_orders")
fn("datetimename_weekday", "DATETIMENAME('W', orderdate)", "dayname(orderdate)", "t_orders")
fn("date_trunc_month", "DATE_TRUNC('M', orderdate)", "strftime(orderdate, '%Y-%m')", "t_orders")
fn("date_trunc_hour", "DATE_TRUNC('HH', orderdate)", "strftime(orderdate, '%Y-%m-%dT%H')", "t_orders")
fn("datetimeadd_day", "CAST(DATETIMEADD('D', 40, orderdate) AS TIMESTAMP_NTZ)", "orderdate + INTERVAL 40 DAY", "t_orders")
fn("datetimeadd_month", "CAST(DATETIMEADD('M', 1, orderdate) AS TIMESTAMP_NTZ)", "date_trunc('month', orderdate) + INTERVAL 1 MONTH + (orderdate - date_trunc('month', orderdate))", "t_orders")
fn("datetimediff_day", "DATETIMEDIFF('D', orderdate, TIMESTAMP '2000-01-01')", "CAST(trunc(epoch_us(TIMESTAMP '2000-01-01' - orderdate) / 86400000000.0) AS BIGINT)", "t_orders")
fn("datetimediff_month", "DATETIMEDIFF('M', orderdate, TIMESTAMP '2000-01-01')", "12 * (2000 - year(orderdate)) + 1 - month(orderdate)", "t_orders")
fn("datetimefromparts", "CAST(DATETIMEFROMPARTS(2001, 2, 1 + size % 28, 3, 4, 5, 6) AS TIMESTAMP_NTZ)", "make_timestamp(2001, 2, 1 + size % 28, 3, 4, 5.006)")
fn("totimestamp", "CAST(TOTIMESTAMP(size * 100000, 's') AS TIMESTAMP_NTZ)", "make_timestamp(size * 100000 * 1000000)")
fn("current_date", "CURRENT_DATE <= CURRENT_TIMESTAMP", "TRUE")


# statements and streams: each over a store of its own in the shared folder


def _session(spark: SparkSession) -> Session:
    return Session(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def statements(name: str, texts: list[str], oracle: str) -> None:
    """Statements after the parts table was made from the generated one; the last is a SELECT or PREDICT."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = _session(spark)
        session.run("CREATE TABLE parts (_id id, name string, type string, size int min 0 max 1000000, price decimal(2))")
        session.store.write("parts", index_table(spark, sf_dir, "parts"))
        return [session.run(t) for t in texts][-1]

    add(name, run, oracle)


statements("stmt_insert", ["INSERT INTO parts (_id, name, size) VALUES (1, 'new name', 77), (90000001, 'more', 5)", "SELECT _id, name, type, size FROM parts"], "SELECT _id, CASE WHEN _id = 1 THEN 'new name' ELSE name END AS name, type, CASE WHEN _id = 1 THEN 77 ELSE size END AS size FROM t_parts UNION ALL SELECT 90000001, 'more', NULL, 5")
statements("stmt_replace", ["REPLACE INTO parts (_id, size) VALUES (2, 8)", "SELECT _id, name, size FROM parts"], "SELECT _id, name, CASE WHEN _id = 2 THEN 8 ELSE size END AS size FROM t_parts")
statements("stmt_delete", ["DELETE FROM parts WHERE size > 10", "SELECT _id FROM parts"], "SELECT _id FROM t_parts WHERE size <= 10")
statements("stmt_truncate", ["DELETE FROM parts", "SELECT count(*) AS n FROM parts"], "SELECT CAST(0 AS BIGINT) AS n")
statements("stmt_copy", ["COPY parts TO copied WHERE size = 3", "SELECT _id, price FROM copied"], "SELECT _id, price FROM t_parts WHERE size = 3")
statements("stmt_view", ["CREATE VIEW small AS SELECT _id, size FROM parts WHERE size < 5", "ALTER VIEW small AS SELECT _id, size FROM parts WHERE size < 4", "SELECT * FROM small"], "SELECT _id, size FROM t_parts WHERE size < 4")
statements("stmt_alter", ["ALTER TABLE parts ADD COLUMN extra int", "ALTER TABLE parts RENAME COLUMN name TO title", "ALTER TABLE parts DROP COLUMN type", "SELECT _id, title, extra FROM parts"], "SELECT _id, name AS title, CAST(NULL AS BIGINT) AS extra FROM t_parts")
statements("stmt_bulk_csv", ["BULK INSERT INTO parts (_id, name, size) MAP (0 id, 1 string, 2 int) TRANSFORM (@0, @1, @2 + 1) FROM '90000002,x,4\n90000003,y,5' WITH FORMAT 'CSV' INPUT 'STREAM'", "SELECT _id, name, size FROM parts WHERE _id > 90000000"], "SELECT CAST(90000002 AS BIGINT) AS _id, 'x' AS name, CAST(5 AS BIGINT) AS size UNION ALL SELECT 90000003, 'y', 6")
statements("stmt_bulk_ndjson", ["""BULK INSERT INTO parts (_id, name) MAP ('$.k' id, '$.a.b' string) FROM '{"k": 90000004, "a": {"b": "deep"}}' WITH FORMAT 'NDJSON' INPUT 'STREAM'""", "SELECT _id, name FROM parts WHERE _id > 90000000"], "SELECT CAST(90000004 AS BIGINT) AS _id, 'deep' AS name")
statements("stmt_model_predict", ["CREATE MODEL m WITH (modeltype 'linear_regression', labels ['y']) AS SELECT _id, size, 2 * size + 1 AS y FROM parts", "PREDICT USING m SELECT _id, size FROM parts"], "SELECT _id, size, CAST(2 * size + 1 AS DECIMAL(38,2)) AS prediction FROM t_parts")
QUERIES["stmt_model_predict"] = lambda s, d, run=QUERIES["stmt_model_predict"]: run(s, d).withColumn("prediction", F.round("prediction", 2).cast("decimal(38,2)"))
statements("stmt_show_columns", ["SHOW COLUMNS FROM parts"], "SELECT CAST(name AS VARCHAR) AS name, CAST(type AS VARCHAR) AS type, CAST(scale AS INTEGER) AS scale, CAST(min AS BIGINT) AS min, CAST(max AS BIGINT) AS max, CAST(NULL AS VARCHAR) AS timequantum, CAST(NULL AS VARCHAR) AS ttl FROM (VALUES ('_id', 'id', NULL, NULL, NULL), ('name', 'string', NULL, NULL, NULL), ('type', 'string', NULL, NULL, NULL), ('size', 'int', NULL, 0, 1000000), ('price', 'decimal', 2, NULL, NULL)) t(name, type, scale, min, max)")
statements("stmt_system_tables", ["SELECT name FROM system_table_ddl"], "SELECT 'parts' AS name")
statements("stmt_databases", ["CREATE DATABASE d1 WITH UNITS 4 COMMENT 'one'", "CREATE DATABASE d2", "ALTER DATABASE d1 SET UNITS 2", "DROP DATABASE d2", "SHOW DATABASES"], "SELECT 'd1' AS name, CAST(2 AS BIGINT) AS units, 'one' AS description")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders gets another status."""
    session = _session(spark)
    session.run("CREATE TABLE orders (_id id, status string, cents int)")
    session.store.write("orders", index_table(spark, sf_dir, "orders"))
    session.run("CREATE TABLE changes (_id id, status string)")
    session.store.write("changes", index_table(spark, sf_dir, "orders").filter("cents < 10").select("_id", F.lit("U").alias("status")))
    session._upsert("orders", session.run("SELECT _id, status FROM changes"))
    return session.run("SELECT _id, status, cents FROM orders")


def _bulk_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _session(spark)
    session.run("CREATE TABLE p (_id id, brand string)")
    session.run(f"BULK INSERT INTO p (_id, brand) MAP ('p_partkey' id, 'p_brand' string) FROM '{sf_dir}/part.parquet' WITH FORMAT 'PARQUET' INPUT 'FILE'")
    return session.run("SELECT _id, brand FROM p")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _session(spark)
    session.run("CREATE TABLE seen (_id id, value decimal(2), types stringset)")
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("_id"), F.col("event_type").alias("type"))
    folder = f"{session.store.root}/in"
    events.write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder).select("_id", F.array("type").alias("types"))
    ingest(stream, session.store, "seen", f"{session.store.root}/checkpoint").awaitTermination()
    return session.run("SELECT _id, array_join(array_sort(types), ',') AS types FROM seen")


add("stmt_upsert", _upsert, "SELECT _id, CASE WHEN cents < 10 THEN 'U' ELSE status END AS status, cents FROM t_orders")
add("stmt_bulk_parquet", _bulk_parquet, "SELECT _id, brand FROM t_parts")
add("stream_ingest", _stream, "SELECT _id, string_agg(DISTINCT v, ',' ORDER BY v) AS types FROM hits GROUP BY _id")
