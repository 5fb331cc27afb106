"""Writes as frames: each gives the table's rows after the write; a store swaps them in.

An upsert replaces scalars, adds members to sets and ignores nulls. Of several new rows of one record the last one
(by `_order`) wins for scalars and all count for sets. Changes are combined per record before they meet the table.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setwise.operators.tables import Table

ORDER = "_order"


def check_rows(rows: DataFrame, limits: dict[str, tuple[int | None, int | None]] | None = None) -> DataFrame:
    """The rows, with an error for a null or negative `_id` and for values beyond their field's limits."""
    kind = rows.schema["_id"].dataType.typeName()
    bad = F.col("_id").isNull() | ((F.col("_id") < 0) if kind != "string" else F.lit(False))
    out = rows.withColumn("_id", F.when(bad, F.raise_error(F.lit("an _id is null or negative")).cast(rows.schema["_id"].dataType)).otherwise(F.col("_id")))
    for name, (low, high) in (limits or {}).items():
        if name not in rows.columns:
            continue
        over = reduce(lambda a, b: a | b, [F.col(name) < low] * (low is not None) + [F.col(name) > high] * (high is not None), F.lit(False))
        out = out.withColumn(name, F.when(over, F.raise_error(F.lit(f"{name}: value out of range")).cast(rows.schema[name].dataType)).otherwise(F.col(name)))
    return out


def upsert(table: Table, new: DataFrame) -> DataFrame:
    """The table after an insert of `new`, which has `_id`, some fields and perhaps `_order`."""
    fields = [c for c in new.columns if c not in ("_id", ORDER)]
    order = F.col(ORDER) if ORDER in new.columns else F.monotonically_increasing_id()
    new = new.withColumn(ORDER, order)

    def combined(name: str) -> Column:
        if table.is_set(name):
            got = F.collect_list(name)
            return F.when(F.size(got) > 0, F.array_distinct(F.flatten(got))).alias(name)
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(ORDER))).alias(name)

    new = new.groupBy("_id").agg(*(combined(c) for c in fields))
    new = new.select(F.col("_id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in fields))
    both = table.df.join(new, table.df["_id"] == new["__id"], "full")

    def merged(name: str) -> Column:
        if name == "_id":
            return F.coalesce("_id", "__id").alias(name)
        if name not in fields:
            return F.col(name)
        if table.is_set(name):
            return F.when(F.col(name).isNull() | F.col(f"__{name}").isNull(), F.coalesce(name, f"__{name}")).otherwise(F.array_union(name, f"__{name}")).alias(name)
        return F.coalesce(F.col(f"__{name}").cast(table.type(name)), F.col(name)).alias(name)

    return both.select(*(merged(c) for c in table.df.columns))


def set_value(table: Table, record: Any, name: str, value: Any, ts: str | None = None) -> DataFrame:
    """Set(): adds a member to a set, replaces a scalar; a record that isn't there is made."""
    spark, kind = table.df.sparkSession, table.type(name)
    if table.is_quantum(name):
        item = F.array(F.struct(F.lit(value).alias("value"), F.lit(ts).cast(kind.elementType["ts"].dataType).alias("ts")))
    else:
        item = F.array(F.lit(value)) if table.is_set(name) else F.lit(value)
    return upsert(table, spark.range(1).select(F.lit(record).cast(table.type("_id")).alias("_id"), item.cast(kind).alias(name)))


def _without(table: Table, name: str, value: Any) -> Column:
    """The field without a value."""
    c = F.col(name)
    if table.is_quantum(name):
        return F.filter(c, lambda x: x["value"] != F.lit(value))
    return F.array_remove(c, F.lit(value)) if table.is_set(name) else F.when(c != F.lit(value), c)


def _with(table: Table, name: str, value: Any) -> Column:
    c, kind = F.col(name), table.type(name)
    if table.is_quantum(name):
        item = F.array(F.struct(F.lit(value).alias("value"), F.lit(None).cast(kind.elementType["ts"].dataType).alias("ts"))).cast(kind)
        return F.array_union(F.coalesce(c, F.array().cast(kind)), item)
    return F.array_union(F.coalesce(c, F.array().cast(kind)), F.array(F.lit(value)).cast(kind)) if table.is_set(name) else F.lit(value).cast(kind)


def clear(table: Table, record: Any, name: str, value: Any) -> DataFrame:
    """Clear(): removes a value from a record."""
    return table.df.withColumn(name, F.when(F.col("_id") == F.lit(record), _without(table, name, value)).otherwise(F.col(name)))


def clear_row(table: Table, name: str, value: Any) -> DataFrame:
    """ClearRow(): removes a value from every record."""
    return table.df.withColumn(name, _without(table, name, value))


def store(table: Table, inside: DataFrame, name: str, value: Any) -> DataFrame:
    """Store(): the records in `inside` (`_id`) and no others get the value."""
    marked = table.df.join(inside.select("_id").distinct().withColumn("__in", F.lit(True)), "_id", "left")
    return marked.withColumn(name, F.when(F.col("__in"), _with(table, name, value)).otherwise(_without(table, name, value))).select(*table.df.columns)


def delete(table: Table, inside: DataFrame) -> DataFrame:
    """Delete(): the records that aren't in `inside`."""
    return table.df.join(inside.select("_id"), "_id", "left_anti")


def expire(table: Table, name: str, ttl: str, now: str, keep_untimed: bool = True) -> DataFrame:
    """Drops a time-bucketed set's values whose bucket ended longer ago than ttl (such as '1 day')."""
    unit = {"Y": "year", "M": "month", "D": "day", "H": "hour"}[table.quantums.get(name, "YMDH")[-1]]
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {ttl}")
    keep = F.filter(F.col(name), lambda x: F.when(x["ts"].isNull(), F.lit(keep_untimed)).otherwise((F.date_trunc(unit, x["ts"]) + F.expr(f"interval 1 {unit}")).cast("timestamp_ntz") >= limit))
    return table.df.withColumn(name, keep)
