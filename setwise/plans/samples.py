"""The generated tables as indexes, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.operators.engine import Engine
from setwise.operators.tables import Table

ORDERS = "SELECT o_orderkey AS _id, o_custkey AS custkey, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(floor(o_totalprice) AS BIGINT) % 100 AS cents, o_orderdate AS orderdate FROM orders"
PARTS = "SELECT p_partkey AS _id, p_name AS name, p_brand AS brand, p_type AS type, CAST(p_size AS BIGINT) AS size, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part"
CUSTOMERS = "SELECT c_custkey AS _id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer"
LINES = "SELECT l_orderkey AS orderkey, l_partkey AS partkey, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(18,2)) AS discount, l_returnflag AS flag, l_linestatus AS linestatus, l_shipdate AS shipdate FROM lineitem"
#: Members of customers' sets, one row each: urgent and high priorities only, so that some sets are null.
MEMBERS = "SELECT DISTINCT o_custkey AS _id, o_orderpriority AS v FROM orders WHERE o_orderpriority < '3'"
NAMES = {"orders": ORDERS, "parts": PARTS, "customers": CUSTOMERS, "lines": LINES}
#: Common table expressions for the oracle.
WITH = "WITH " + ", ".join(f"t_{k} AS ({v})" for k, v in NAMES.items()) + f", members AS ({MEMBERS}), hits AS (SELECT user_id AS _id, event_type AS v, ts FROM events) "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = {"orders": "orders", "parts": "part", "customers": "customer", "lines": "lineitem"}[name]
    columns = NAMES[name].removeprefix("SELECT ").rpartition(" FROM ")[0]
    depth, parts, at = 0, [], 0
    for k, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(columns[at:k])
            at = k + 1
    return read(spark, sf_dir, source).selectExpr(*parts, columns[at:])


def customers_with_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the set of their urgent and high priorities; null without any."""
    sets = read(spark, sf_dir, "orders").filter("o_orderpriority < '3'").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))
    customers = index_table(spark, sf_dir, "customers")
    return customers.join(sets, customers["_id"] == sets["o_custkey"], "left").drop("o_custkey")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with the time-bucketed set of their event types."""
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct(F.col("event_type").alias("value"), "ts"))).alias("types"))


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine({"orders": Table(index_table(spark, sf_dir, "orders"), foreign={"custkey": "customers"}), "parts": Table(index_table(spark, sf_dir, "parts")), "customers": Table(customers_with_sets(spark, sf_dir)), "users": Table(users(spark, sf_dir), quantums={"types": "YMDH"})})


def views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the indexes, for SQL."""
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    for name in ("orders", "parts", "lines"):
        index_table(spark, sf_dir, name).createOrReplaceTempView(f"t_{name}")
    customers_with_sets(spark, sf_dir).createOrReplaceTempView("t_customers")
    users(spark, sf_dir).createOrReplaceTempView("t_users")
