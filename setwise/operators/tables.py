"""Tables of records: a DataFrame with an `_id` and typed fields.

Field kinds follow from Spark types: arrays are sets, arrays of struct<value, ts> are time-bucketed sets (their
quantum is kept in Table.quantums), integers, decimals and timestamps compare, strings and booleans match.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_BITS = 20
_UNITS = {"Y": "year", "M": "month", "D": "day", "H": "hour"}


@dataclass
class Table:
    df: DataFrame
    quantums: dict[str, str] = field(default_factory=dict)
    #: Fields whose values are ids of another table.
    foreign: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, key: str, quantums: dict[str, str] | None = None, foreign: dict[str, str] | None = None) -> Table:
        return cls(df.withColumnRenamed(key, "_id"), quantums or {}, foreign or {})

    def type(self, name: str) -> T.DataType:
        if name not in self.df.columns:
            raise ValueError(f"no field {name!r}")
        return self.df.schema[name].dataType

    def is_quantum(self, name: str) -> bool:
        t = self.type(name)
        return isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType)

    def is_set(self, name: str) -> bool:
        return isinstance(self.type(name), T.ArrayType)

    def in_range(self, name: str, ts: Column, start: str | None, stop: str | None) -> Column:
        """Whether a value's time bucket is within [start, stop), at the quantum's finest unit; untimed values are not."""
        bucket = F.date_trunc(_UNITS[self.quantums.get(name, "YMDH")[-1]], ts)
        ok = ts.isNotNull()
        if start is not None:
            ok = ok & (bucket >= F.date_trunc(_UNITS[self.quantums.get(name, "YMDH")[-1]], F.to_timestamp(F.lit(start)).cast(self._ts(name))))
        if stop is not None:
            ok = ok & (bucket < F.to_timestamp(F.lit(stop)).cast(self._ts(name)))
        return ok

    def _ts(self, name: str) -> T.DataType:
        return self.type(name).elementType["ts"].dataType

    def members(self, name: str, start: str | None = None, stop: str | None = None) -> Column:
        """The values of a set field as an array, of a time-bucketed one those of a time range."""
        if not self.is_quantum(name):
            return F.col(name)
        c = F.col(name)
        if start is not None or stop is not None:
            c = F.filter(c, lambda x: self.in_range(name, x["ts"], start, stop))
        return F.array_distinct(F.transform(c, lambda x: x["value"]))

    def values(self, name: str, start: str | None = None, stop: str | None = None) -> Column:
        """One value per row: members of sets exploded."""
        return F.explode(self.members(name, start, stop)) if self.is_set(name) else F.col(name)

    def shard(self) -> Column:
        return F.shiftright(F.col("_id").cast("long"), SHARD_BITS)
