"""Calls to DataFrames.

A set of records is a boolean column over its table: set algebra on one table is one scan. What needs other rows
(limits, sorts, shifts, other tables) becomes a frame of ids that is joined as a flag, so every set stays a column.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setwise.functions.percentile import percentile
from setwise.operators import writes
from setwise.operators.tables import Table
from setwise.plans.calls import Call, Condition, Name, CallError, parse

_OPTIONS = {"from", "to", "limit", "offset", "n", "k", "ids", "threshold", "tanimotoThreshold", "field", "index", "filter", "previous", "column", "like", "in", "aggregate", "having", "sort", "rows", "columns", "shards", "nth", "sort-desc"}
SETS = {"row", "range", "bitmap", "union", "intersect", "difference", "xor", "not", "all", "constrow", "limit", "shift", "unionrows", "innerunionrows", "distinct", "sort"}


def compare(c: Column, cond: Condition, cast: T.DataType | None = None) -> Column:
    """A comparison, null where the field is; between forms with their own ends."""

    def lit(v: Any) -> Column:
        out = F.lit(v.text if isinstance(v, Name) else v)
        return out.cast(cast) if isinstance(cast, T.TimestampType | T.TimestampNTZType | T.DateType) else out

    ops: dict[str, Callable[[Column, Any], Column]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    if cond.op == "between":
        low_op, low, high_op, high = cond.value
        return ops[">" if low_op == "<" else ">="](c, lit(low)) & ops[high_op](c, lit(high))
    if cond.op == "><":
        low, high = cond.value
        return c.between(lit(low), lit(high))
    if cond.value is None:
        return c.isNull() if cond.op == "==" else c.isNotNull()
    return ops[cond.op](c, lit(cond.value))


class _Scan:
    """A table while a set is compiled over it: flags of other frames get joined on."""

    def __init__(self, engine: Engine, table: Table):
        self.engine, self.table, self.df, self.flags = engine, table, table.df, 0

    def flag(self, ids: DataFrame) -> Column:
        name = f"__in{self.flags}"
        self.flags += 1
        self.df = self.df.join(ids.select("_id").distinct().withColumn(name, F.lit(True)), "_id", "left")
        return F.coalesce(F.col(name), F.lit(False))


    def flag_values(self, column: str, found: DataFrame) -> Column:
        """Records whose value is among those of a frame."""
        name = f"__in{self.flags}"
        self.flags += 1
        values = found.select(F.col("value").alias(f"{name}_v"), F.lit(True).alias(name)).distinct()
        self.df = self.df.join(values, F.col(column) == F.col(f"{name}_v"), "left").drop(f"{name}_v")
        return F.coalesce(F.col(name), F.lit(False))


class Engine:
    def __init__(self, tables: dict[str, Table]):
        self.tables = tables

    def query(self, index: str, text: str, variables: dict[str, Any] | None = None) -> DataFrame:
        """The answer to the last call of a text."""
        return [self.execute(index, c) for c in parse(text, variables)][-1]

    def execute(self, index: str, call: Call) -> DataFrame:
        index = self._index(call, index)
        if call.name == "sort":
            return self._sorted(index, call).select("_id", "value")
        if call.name == "distinct":
            return self.distinct(index, call)
        if call.name in SETS:
            return self.ids(index, call)
        handler = getattr(self, f"_{call.name}", None)
        if handler is None:
            raise CallError(f"unknown call {call.name!r}")
        return handler(index, call)

    # sets

    def _index(self, call: Call, index: str) -> str:
        other = call.args.get("index", index)
        other = other.text if isinstance(other, Name) else other
        if other not in self.tables:
            raise CallError(f"no index {other!r}")
        return other

    def ids(self, index: str, call: Call) -> DataFrame:
        if self._index(call, index) == index and (call.name == "limit" or (call.name == "all" and call.args.keys() & {"limit", "offset"})):
            return self._limited(self.ids(index, call.children[0]) if call.children else self.tables[index].df.select("_id"), call)  # no need of a flag
        return self.matching(index, call).select("_id")

    def matching(self, index: str, call: Call | None) -> DataFrame:
        """Rows of a table whose record is in the set; all of them without one."""
        if call is None:
            return self.tables[index].df
        scan = _Scan(self, self.tables[index])
        keep = self.predicate(scan, call, index)
        out = scan.df.filter(keep)
        return out.drop(*(f"__in{k}" for k in range(scan.flags))) if scan.flags else out

    def predicate(self, scan: _Scan, call: Call, index: str) -> Column:
        """True where the record is in the set, else false: never null."""
        other = self._index(call, index)
        if call.name == "distinct" or other != index:
            frame = self.distinct(other, call).withColumnRenamed("value", "_id") if call.name == "distinct" else self.ids(other, call)
            return scan.flag(frame)
        kids = lambda: [self.predicate(scan, c, index) for c in call.children]
        if call.name in ("row", "range", "bitmap"):
            return F.coalesce(self._row_test(scan.table, call), F.lit(False))
        if call.name == "union":
            out = F.lit(False)
            for k in kids():
                out = out | k
            return out
        if call.name == "intersect":
            if not call.children:
                raise CallError("Intersect() needs an argument")
            out = F.lit(True)
            for k in kids():
                out = out & k
            return out
        if call.name == "difference":
            first, *rest = kids()
            for k in rest:
                first = first & ~k
            return first
        if call.name == "xor":
            first, *rest = kids()
            for k in rest:
                first = first != k
            return first
        if call.name == "not":
            if len(call.children) != 1:
                raise CallError("Not() takes one argument")
            return ~kids()[0]
        if call.name == "all":
            if "limit" not in call.args and "offset" not in call.args:
                return F.lit(True)
            return scan.flag(self._limited(scan.table.df.select("_id"), call))
        if call.name == "constrow":
            return F.col("_id").isin(call.args["columns"])
        if call.name == "limit":
            return scan.flag(self._limited(self.ids(index, call.children[0]), call))
        if call.name == "sort":
            return scan.flag(self._sorted(index, call))
        if call.name == "shift":
            return scan.flag(self.ids(index, call.children[0]).select((F.col("_id") + call.args.get("n", 0)).alias("_id")))
        if call.name == "innerunionrows":
            return self._any_of(scan.table, _field(call), F.array(*(F.lit(x) for x in call.args["rows"])), call)
        if call.name == "unionrows":
            out = F.lit(False)
            for c in call.children:
                name = _field(c)
                if c.name == "rows" and not c.children and not c.args.keys() - {"like", "field", "_field"}:
                    out = out | self._any_like(scan.table, name, c.args.get("like"))
                    continue
                if not scan.table.is_set(name):
                    out = out | scan.flag_values(name, self.execute(index, c))
                    continue
                found = self.execute(index, c).select(F.col("value").alias("__v"))
                rows = scan.table.df.select("_id", scan.table.values(name).alias("__v"))
                out = out | scan.flag(rows.join(found, "__v", "left_semi"))
            return out
        raise CallError(f"{call.name} is no set of records")

    def _any_like(self, table: Table, name: str, pattern: str | None) -> Column:
        """Whether a record has a value of a field, one that a pattern fits if there is one."""
        fits = (lambda x: x.like(pattern)) if pattern is not None else (lambda x: x.isNotNull())
        return F.coalesce(F.exists(table.members(name), fits) if table.is_set(name) else fits(F.col(name)), F.lit(False))

    def _any_of(self, table: Table, name: str, values: Column, call: Call) -> Column:
        if table.is_set(name):
            return F.coalesce(F.arrays_overlap(table.members(name, call.args.get("from"), call.args.get("to")), values), F.lit(False))
        return F.coalesce(F.array_contains(values, F.col(name)), F.lit(False))

    def _row_test(self, table: Table, call: Call) -> Column:
        names = [a for a in call.args if a not in _OPTIONS or a in table.df.columns]
        if len(names) != 1:
            raise CallError("Row() takes one field")
        name, value = names[0], call.args[names[0]]
        start, stop = call.args.get("from"), call.args.get("to")
        kind = table.type(name)
        if isinstance(value, Condition):
            if value.value is None or not table.is_set(name):
                return compare(F.col(name), value, kind)
            if value.op not in ("==", "!="):
                raise CallError(f"{name} is a set: only = compares")
            hit = F.array_contains(table.members(name), F.lit(value.value))
            return hit if value.op == "==" else ~hit
        value = value.text if isinstance(value, Name) else value
        if value is None:
            return F.col(name).isNull()
        if table.is_set(name):
            return F.array_contains(table.members(name, start, stop), F.lit(value))
        return F.col(name) == F.lit(value)

    def _limited(self, ids: DataFrame, call: Call) -> DataFrame:
        out = ids.orderBy("_id")
        if call.args.get("offset"):
            out = out.offset(call.args["offset"])
        return out.limit(call.args["limit"]) if "limit" in call.args else out

    def _sorted(self, index: str, call: Call) -> DataFrame:
        name = _field(call)
        rows = self.matching(index, call.children[0] if call.children else None).select("_id", F.col(name).alias("value")).filter("value is not null")
        order = F.col("value").desc() if call.args.get("sort-desc") in (True, 1) else F.col("value").asc()
        out = rows.orderBy(order, "_id")
        if call.args.get("offset"):
            out = out.offset(call.args["offset"])
        return out.limit(call.args["limit"]) if "limit" in call.args else out

    def distinct(self, index: str, call: Call) -> DataFrame:
        name = _field(call)
        rows = self.matching(index, call.children[0] if call.children else None)
        return rows.select(self.tables[index].values(name).alias("value")).filter("value is not null").distinct()

    # aggregates and lookups

    def _options(self, index: str, call: Call) -> DataFrame:
        shards = call.args.get("shards")
        if shards is None:
            return self.execute(index, call.children[0])
        t = self.tables[index]
        part = Table(t.df.filter(t.shard().isin(shards)), t.quantums, t.foreign)
        return Engine({**self.tables, index: part}).execute(index, call.children[0])

    def _count(self, index: str, call: Call) -> DataFrame:
        child = call.children[0]
        rows = self.distinct(self._index(child, index), child) if child.name == "distinct" else self.matching(self._index(child, index), child)
        return rows.agg(F.count("*").alias("count"))

    def _numbers(self, index: str, call: Call) -> DataFrame:
        return self.matching(index, call.children[0] if call.children else None).select(F.col(_field(call)).alias("value"))

    def _sum(self, index: str, call: Call) -> DataFrame:
        rows = self._numbers(index, call)
        total = F.sum("value")
        kind = rows.schema["value"].dataType
        total = total.cast(f"decimal(38,{kind.scale})") if isinstance(kind, T.DecimalType) else total
        return rows.agg(F.coalesce(total, F.lit(0)).alias("value"), F.count("value").alias("count"))

    def _extreme(self, index: str, call: Call, pick: Callable[[str], Column]) -> DataFrame:
        by = self._numbers(index, call).filter("value is not null").groupBy("value").agg(F.count("*").alias("count"))
        return by.agg(pick(F.struct("value", "count")).alias("x")).select("x.value", F.coalesce("x.count", F.lit(0).cast("long")).alias("count"))

    def _min(self, index: str, call: Call) -> DataFrame:
        return self._extreme(index, call, F.min)

    def _max(self, index: str, call: Call) -> DataFrame:
        return self._extreme(index, call, F.max)

    def _members(self, index: str, call: Call, child: Call | None) -> DataFrame:
        t = self.tables[index]
        return self.matching(index, child).select("_id", t.values(_field(call), call.args.get("from"), call.args.get("to")).alias("value")).filter("value is not null")

    def _minrow(self, index: str, call: Call) -> DataFrame:
        by = self._members(index, call, call.children[0] if call.children else None).groupBy("value").agg(F.count("*").alias("count"))
        return by.agg(F.min(F.struct("value", "count")).alias("x")).select("x.value", "x.count")

    def _maxrow(self, index: str, call: Call) -> DataFrame:
        by = self._members(index, call, call.children[0] if call.children else None).groupBy("value").agg(F.count("*").alias("count"))
        return by.agg(F.max(F.struct("value", "count")).alias("x")).select("x.value", "x.count")

    def _percentile(self, index: str, call: Call) -> DataFrame:
        child = call.args.get("filter") or (call.children[0] if call.children else None)
        rows = self.matching(index, child).select(F.col(_field(call)).alias("value"))
        return percentile(rows, "value", Decimal(str(call.args["nth"])))

    def _topk(self, index: str, call: Call) -> DataFrame:
        child = call.args.get("filter") or (call.children[0] if call.children else None)
        by = self._members(index, call, child).groupBy("value").agg(F.count("*").alias("count"))
        out = by.orderBy(F.desc("count"), "value")
        return out.limit(call.args["k"]) if "k" in call.args else out

    def _topn(self, index: str, call: Call) -> DataFrame:
        rows = self._members(index, call, None)
        if "ids" in call.args:
            rows = rows.filter(F.col("value").isin(call.args["ids"]))
        if call.children:
            scan = _Scan(self, self.tables[index])
            inside = self.predicate(scan, call.children[0], index)
            name = _field(call)
            marked = scan.df.select(scan.table.values(name).alias("value"), inside.alias("s")).filter("value is not null")
            if "ids" in call.args:
                marked = marked.filter(F.col("value").isin(call.args["ids"]))
            by = marked.groupBy("value").agg(F.count("*").alias("whole"), F.count_if("s").alias("count")).filter("count > 0")
            if "tanimotoThreshold" in call.args:
                src = self.matching(index, call.children[0]).agg(F.count("*").alias("src"))
                by = by.crossJoin(F.broadcast(src)).filter(F.ceil(100 * F.col("count") / (F.col("whole") + F.col("src") - F.col("count"))) > call.args["tanimotoThreshold"])  # src is one row
            by = by.select("value", "count")
        else:
            by = rows.groupBy("value").agg(F.count("*").alias("count"))
        if call.args.get("threshold"):
            by = by.filter(F.col("count") >= call.args["threshold"])
        out = by.orderBy(F.desc("count"), "value")
        return out.limit(call.args["n"]) if call.args.get("n") else out

    def _rows(self, index: str, call: Call) -> DataFrame:
        t, name = self.tables[index], _field(call)
        rows = t.df.filter(F.col("_id") == call.args["column"]) if "column" in call.args else t.df
        out = rows.select(t.values(name, call.args.get("from"), call.args.get("to")).alias("value")).filter("value is not null").distinct()
        if "in" in call.args:
            return out.filter(F.col("value").isin(call.args["in"])).orderBy("value")
        if "previous" in call.args:
            p = call.args["previous"]
            out = out.filter(F.col("value") > F.lit(p.text if isinstance(p, Name) else p))
        if "like" in call.args:
            out = out.filter(F.col("value").like(call.args["like"]))
        out = out.orderBy("value")
        return out.limit(call.args["limit"]) if "limit" in call.args else out

    def _groupby(self, index: str, call: Call) -> DataFrame:
        t = self.tables[index]
        rows = self.matching(index, call.args.get("filter"))
        groups = []
        agg = call.args.get("aggregate")
        needed = [_field(c) for c in call.children] + ([_field(agg)] if agg and agg.name == "sum" else [_field(agg.children[0])] if agg else [])
        rows = rows.select(*dict.fromkeys(["_id", *needed]))
        for k, c in enumerate(call.children):
            name = _field(c)
            if isinstance(t.type(name), T.DecimalType):
                raise CallError(f"{name}: decimals are no group keys")
            own = f"__g{k}"
            rows = rows.withColumn(own, t.values(name, c.args.get("from"), c.args.get("to"))).filter(F.col(own).isNotNull())
            if c.args.keys() & {"limit", "previous", "like", "in", "column"}:
                rows = rows.join(self._rows(index, c).select(F.col("value").alias(own)), own, "left_semi")
            groups.append((own, name))
        value = None
        if agg is not None and agg.name == "sum":
            rows = rows.filter(F.col(_field(agg)).isNotNull())
            value = F.sum(_field(agg)).alias("sum")
        elif agg is not None and agg.name == "count":
            value = F.countDistinct(t.values(_field(agg.children[0])) if not t.is_set(_field(agg.children[0])) else F.col(_field(agg.children[0]))).alias("agg")
        elif agg is not None:
            raise CallError(f"unknown aggregate {agg.name!r}")
        out = rows.groupBy(*(g for g, _ in groups)).agg(F.count("*").alias("count"), *([value] if value is not None else []))
        having = call.args.get("having")
        if having is not None:
            for name, cond in having.args.items():
                out = out.filter(compare(F.col(name), cond))
        order = []
        for part in (x.strip().split() for x in call.args.get("sort", "").split(",") if x.strip()):
            order.append(F.col(part[0]).desc() if part[1:] == ["desc"] else F.col(part[0]).asc())
        out = out.orderBy(*order, *(g for g, _ in groups)) if order or "limit" in call.args or "offset" in call.args else out
        if call.args.get("offset"):
            out = out.offset(call.args["offset"])
        if "limit" in call.args:
            out = out.limit(call.args["limit"])
        return out.select(*(F.col(g).alias(n) for g, n in groups), *[c for c in out.columns if not c.startswith("__g")])

    # writes: the table's rows afterwards, which later calls of this engine see

    def _written(self, index: str, df: DataFrame) -> DataFrame:
        t = self.tables[index]
        self.tables = {**self.tables, index: Table(df, t.quantums, t.foreign)}
        return df

    def _set(self, index: str, call: Call) -> DataFrame:
        record, *ts = call.positional
        (name, value), = call.args.items()
        return self._written(index, writes.set_value(self.tables[index], _plain(record), name, _plain(value), ts[0] if ts else None))

    _setbit = _set

    def _clear(self, index: str, call: Call) -> DataFrame:
        (name, value), = call.args.items()
        return self._written(index, writes.clear(self.tables[index], _plain(call.positional[0]), name, _plain(value)))

    def _clearrow(self, index: str, call: Call) -> DataFrame:
        (name, value), = call.args.items()
        return self._written(index, writes.clear_row(self.tables[index], name, _plain(value)))

    def _store(self, index: str, call: Call) -> DataFrame:
        (name, value), = call.args.items()
        return self._written(index, writes.store(self.tables[index], self.ids(index, call.children[0]), name, _plain(value)))

    def _delete(self, index: str, call: Call) -> DataFrame:
        return self._written(index, writes.delete(self.tables[index], self.ids(index, call.children[0])))

    def _apply(self, index: str, call: Call) -> DataFrame:
        from setwise.operators import arrays

        if len(call.children) > 1 or not 1 <= len(call.positional) <= 2:
            raise CallError("Apply() takes a set, a program and a reduction")
        return arrays.apply_program(self, index, call.children[0] if call.children else None, *call.positional)

    def _arrow(self, index: str, call: Call) -> DataFrame:
        from setwise.operators import arrays

        return arrays.arrow(self, index, call.children[0] if call.children else None, call.args.get("header"))

    def _includescolumn(self, index: str, call: Call) -> DataFrame:
        rows = self.matching(index, call.children[0]).filter(F.col("_id") == call.args["column"])
        return rows.agg((F.count("*") > 0).alias("included"))

    def _fieldvalue(self, index: str, call: Call) -> DataFrame:
        return self.tables[index].df.filter(F.col("_id") == call.args["column"]).select(F.col(_field(call)).alias("value"))

    def _extract(self, index: str, call: Call) -> DataFrame:
        source, *fields = call.children
        t = self.tables[index]
        cols = [(t.members(_field(c), c.args.get("from"), c.args.get("to")) if t.is_set(_field(c)) else F.col(_field(c))).alias(_field(c)) for c in fields]
        if source.name == "sort":
            order = F.desc("__v") if source.args.get("sort-desc") in (True, 1) else F.asc("__v")
            return t.df.join(self._sorted(index, source).withColumnRenamed("value", "__v"), "_id").orderBy(order, "_id").select("_id", *cols)
        return self.matching(index, source).select("_id", *cols)


def _plain(value: Any) -> Any:
    return value.text if isinstance(value, Name) else value


def _field(call: Call) -> str:
    """The field that a call names: field=, _field, or its first bare word."""
    found = call.args.get("field", call.positional[0] if call.positional else None)
    if found is None:
        raise CallError(f"{call.name} needs a field")
    return found.text if isinstance(found, Name) else found
