"""Bulk sources: CSV by place, NDJSON by path, Parquet by column, and headers that name their fields' types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names of a header (`source___target__Type_argument`) and the dialect's types.
HEADER_TYPES = {"ID": "id", "Bool": "bool", "String": "string", "Int": "int", "Decimal": "decimal", "StringArray": "stringset", "IDArray": "idset", "DateInt": "int", "RecordTime": "timestamp", "Timestamp": "timestamp", "LookupText": "string", "ForeignKey": "id", "SignedIntBoolKey": "int", "Ignore": None}


def converted(c: Column, kind: T.DataType) -> Column:
    """Text as the dialect's bulk load reads it: one scalar makes a set of one, whole numbers are seconds."""
    if isinstance(kind, T.ArrayType):
        return F.when(c.isNotNull(), F.array(converted(c, kind.elementType)))
    if isinstance(kind, T.TimestampType):
        return F.coalesce(F.timestamp_seconds(c.try_cast("bigint")), c.cast("timestamp"))
    if isinstance(kind, T.BooleanType):
        return F.lower(c).isin("1", "t", "true").cast("boolean")
    return c.cast(kind)


def bulk(spark: SparkSession, kind: str, source: str, maps: list[tuple[str, T.DataType]], inline: bool = False, header: bool = False, missing: bool = False) -> DataFrame:
    """Columns _0, _1 … of a source, by place (CSV), JSON path (NDJSON) or name (Parquet)."""
    kind = kind.upper()
    if kind == "PARQUET":
        df = spark.read.parquet(source)
        return df.select(*(F.col(place).cast(t).alias(f"_{k}") for k, (place, t) in enumerate(maps)))
    lines = spark.createDataFrame([(x,) for x in source.splitlines() if x], "value string") if inline else None
    if kind == "CSV":
        names = [f"_{k}" for k in range(max(int(p) for p, _ in maps) + 1)]
        schema = ", ".join(f"{n} string" for n in names)
        reader = spark.read.schema(schema).option("header", header and not inline)
        if lines is not None:
            rows = [x for x in source.splitlines() if x][1 if header else 0 :]
            df = spark.createDataFrame([(x,) for x in rows], "value string").select(F.from_csv("value", schema).alias("r")).select("r.*")
        else:
            df = reader.csv(source)
        return df.select(*(converted(F.col(f"_{int(p)}"), t).alias(f"_{k}") for k, (p, t) in enumerate(maps)))
    if kind == "NDJSON":
        df = lines if lines is not None else spark.read.text(source)
        out = []
        for k, (path, t) in enumerate(maps):
            got = F.get_json_object("value", path)
            if not missing:
                got = F.when(got.isNull() & F.col("value").isNull(), F.raise_error(F.lit(f"{path}: no value"))).otherwise(got)
            listed = F.from_json(got, t) if isinstance(t, T.ArrayType) else None
            out.append((F.when(got.startswith("["), listed).otherwise(converted(got, t)) if listed is not None else converted(got, t)).alias(f"_{k}"))
        return df.select(*out)
    raise ValueError(f"unknown format {kind!r}")


def header_fields(header: list[str]) -> list[dict]:
    """Fields of a typed header; ignored ones have no type."""
    out = []
    for h in header:
        m = re.fullmatch(r"(?:(?P<source>.+?)___)?(?P<name>.+?)__(?P<type>[A-Za-z]+)(?:_(?P<arg>.+))?", h)
        if not m or m["type"] not in HEADER_TYPES:
            raise ValueError(f"{h!r} names no field")
        out.append({"source": m["source"] or m["name"], "name": m["name"], "type": HEADER_TYPES[m["type"]]} | ({"scale": int(m["arg"])} if m["type"] == "Decimal" and m["arg"] else {}))
    return out
