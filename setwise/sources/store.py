"""A folder of tables: each write makes a new version of Parquet files, then a new small catalogue file points to it.

Catalogue files are numbered and come into being by a rename; the highest number counts, so a crash leaves the one before.

Readers of an older version keep it until the next write but one; there is one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from setwise.operators.tables import Table

#: The dialect's types.
TYPES = {"id": T.LongType(), "int": T.LongType(), "string": T.StringType(), "bool": T.BooleanType(), "timestamp": T.TimestampType(), "idset": T.ArrayType(T.LongType()), "stringset": T.ArrayType(T.StringType())}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; unset, one of our own in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/checkpoints/setwise"


def spark_type(name: str, scale: int = 0) -> T.DataType:
    name = name.lower()
    if name == "decimal":
        return T.DecimalType(38, scale)
    if name in ("idsetq", "stringsetq"):
        return T.ArrayType(T.StructType([T.StructField("value", TYPES[name[:-1]].elementType), T.StructField("ts", T.TimestampNTZType())]))
    if name not in TYPES:
        raise ValueError(f"unknown type {name!r}")
    return TYPES[name]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self.catalog: dict[str, Any] = self._read()

    def _numbers(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"catalog-(\d+)\.json", n)))

    def _read(self) -> dict[str, Any]:
        numbers = self._numbers()
        found = {} if not numbers else json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/catalog-{numbers[-1]}.json", wholetext=True).collect()))
        return {"tables": {}, "views": {}, "models": {}, "functions": {}, "databases": {}} | found

    def save(self) -> None:
        numbers = self._numbers()
        p, new = self._path(f"{self.root}/catalog-{(numbers or [0])[-1] + 1}.json"), self._path(f"{self.root}/_{uuid.uuid4().hex}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(self.catalog).encode()))
        out.close()
        if not self._fs.rename(new, p):
            raise OSError(f"{p} couldn't be written")
        for k in numbers[:-1]:
            self._fs.delete(self._path(f"{self.root}/catalog-{k}.json"), False)

    def create(self, name: str, columns: list[dict[str, Any]], comment: str = "") -> None:
        """columns: name, type, scale, and the options min, max, quantum, ttl."""
        ids = [c for c in columns if c["name"] == "_id"]
        if len(ids) != 1 or ids[0]["type"] not in ("id", "string"):
            raise ValueError("a table needs an _id of type id or string")
        self.catalog["tables"][name] = {"columns": columns, "comment": comment, "path": None, "old": None}
        self.save()

    def schema(self, name: str) -> T.StructType:
        return T.StructType([T.StructField(c["name"], spark_type(c["type"], c.get("scale", 0))) for c in self.meta(name)["columns"]])

    def meta(self, name: str) -> dict[str, Any]:
        if name not in self.catalog["tables"]:
            raise ValueError(f"table {name!r} not found")
        return self.catalog["tables"][name]

    def read(self, name: str) -> DataFrame:
        path = self.meta(name)["path"]
        schema = self.schema(name)
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> Table:
        return Table(self.read(name), {c["name"]: c["quantum"] for c in self.meta(name)["columns"] if c.get("quantum")})

    def limits(self, name: str) -> dict[str, tuple[int | None, int | None]]:
        return {c["name"]: (c.get("min"), c.get("max")) for c in self.meta(name)["columns"] if "min" in c or "max" in c}

    def write(self, name: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Swap in the table's rows; a stream's batch with a number that was written before changes nothing."""
        meta = self.meta(name)
        if batch is not None and batch[1] <= meta.get("batches", {}).get(batch[0], -1):
            return
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        names = [f.name for f in self.schema(name).fields]
        rows.select(*names).write.parquet(path)
        if meta["old"]:
            self._fs.delete(self._path(meta["old"]), True)
        meta["old"], meta["path"] = meta["path"], path
        if batch is not None:
            meta["batches"] = {**meta.get("batches", {}), batch[0]: batch[1]}
        self.save()

    def drop(self, name: str) -> None:
        self.meta(name)
        del self.catalog["tables"][name]
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
        self.save()
