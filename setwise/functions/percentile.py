"""The percentile by bisection of the value domain between the extremes: it may be a value that no record has."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Steps of the bisection that one pass over the counts settles: at most 2**STEPS candidates are compared at once.
STEPS = 10


def middle(low: int, high: int) -> int:
    """Half way, rounded towards zero where the ends differ in sign."""
    both = low + high
    return both // 2 if low >= 0 or high <= 0 else -(-both // 2) if both < 0 else both // 2


def candidates(low: int, high: int, steps: int) -> list[int]:
    """What the bisection may look at in its next steps, in order."""
    out, ranges = [], [(low, high)]
    for _ in range(steps):
        ranges = [r for a, b in ranges if a < b for m in [middle(a, b)] for r in [(a, m - 1), (m + 1, b)] if out.append(m) is None]
    return sorted(set(out))


def bisect(low: int, high: int, less: int, greater: int, below, above, span: list[int] | None = None) -> int:  # noqa: ANN001
    """The candidate at which at most `less` values are smaller and at most `greater` larger; span tells what is left."""
    at = low
    while low < high:
        if span:
            span[:] = low, high
        at = middle(low, high)
        if below(at) > less:
            high = at - 1
        elif above(at) > greater:
            low = at + 1
        else:
            break
    return at


def _ranks(counts: DataFrame, at: list[int]) -> dict[int, tuple[int, int]]:
    """For each of a few numbers, how many values are smaller and how many larger, in one pass over the counts."""
    edges = np.array(at, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, above = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            v, n = b.column("v").to_numpy(), b.column("n").to_numpy()
            np.add.at(below, np.searchsorted(edges, v, "right"), n)
            np.add.at(above, np.searchsorted(edges, v, "left"), n)
        yield pa.record_batch([pa.array(range(len(edges) + 1), pa.int32()), pa.array(below), pa.array(above)], names=["k", "below", "above"])

    rows = counts.mapInArrow(run, "k int, below long, above long").groupBy("k").agg(F.sum("below").alias("below"), F.sum("above").alias("above")).collect()
    below, above = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for r in rows:
        below[r["k"]], above[r["k"]] = r["below"], r["above"]
    smaller, larger = np.cumsum(below), np.cumsum(above[::-1])[::-1]
    return {c: (int(smaller[k]), int(larger[k + 1])) for k, c in enumerate(at)}


def percentile(rows: DataFrame, name: str, nth: Decimal) -> DataFrame:
    """One row: the value, null without any, and how many values were looked at."""
    if not 0 <= nth <= 100:
        raise ValueError("nth is from 0 to 100")
    spark, kind = rows.sparkSession, rows.schema[name].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    whole = (F.col(name) * 10**scale).cast("long") if scale else F.unix_micros(name) if isinstance(kind, T.TimestampType) else F.col(name).cast("long")
    counts = rows.filter(F.col(name).isNotNull()).groupBy(whole.alias("v")).agg(F.count("*").alias("n"))
    n, low, high = counts.agg(F.sum("n"), F.min("v"), F.max("v")).first()
    schema = T.StructType([T.StructField("value", kind), T.StructField("count", T.LongType())])
    if not n:
        return spark.createDataFrame([(None, 0)], schema)
    less, greater = int(n * nth / 100), int(n * (100 - nth) / 100)
    if greater and not less:
        at = low
    elif not greater:
        at = high
    else:
        known: dict[int, tuple[int, int]] = {}

        def look(c: int) -> tuple[int, int]:
            """How many values are smaller than c and how many larger; a pass answers for the steps after c, too."""
            if c not in known:
                known.update(_ranks(counts, candidates(span[0], span[1], STEPS)))
            return known[c]

        at = bisect(low, high, less, greater, lambda c: look(c)[0], lambda c: look(c)[1], span := [low, high])
    if scale:
        value = Decimal(at).scaleb(-scale)
    elif isinstance(kind, T.TimestampType):
        return spark.range(1).select(F.timestamp_micros(F.lit(at)).alias("value"), F.lit(n).cast("long").alias("count"))
    else:
        value = at
    return spark.createDataFrame([(value, n)], schema)
