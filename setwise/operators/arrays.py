"""The array side of a table: programs over columns, and fetching rows as Arrow."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setwise.operators.engine import Engine
from setwise.plans.calls import Call, CallError

#: Reductions of the array language: a partial in each task, then one over the partials.
REDUCTIONS = {"+/": F.sum, "max/": F.max, "min/": F.min, "rho": F.count}


def arrow(engine: Engine, index: str, call: Call | None, header: list[str] | None = None) -> DataFrame:
    """Rows of a set with some columns; `.toArrow()` fetches them."""
    rows = engine.matching(index, call)
    return rows.select("_id", *header) if header else rows


def apply_program(engine: Engine, index: str, call: Call | None, program: str, reduce: str = "_") -> DataFrame:
    """An expression over columns (+ - * / and parentheses), or a reduction such as '+/ a * b': one column, value.

    A second program reduces the first one's values, which it calls `_`.
    """
    if reduce.strip() != "_":
        name = next((n for n in REDUCTIONS if reduce.strip().startswith(n)), None)
        if name is None:
            raise CallError(f"{reduce!r} is no reduction")
        text = re.sub(r"(?<!\w)_(?!\w)", "value", reduce.strip()[len(name) :])
        return apply_program(engine, index, call, program).agg(REDUCTIONS[name](F.expr(text)).alias("value"))
    rows, text = engine.matching(index, call), program.strip()
    for name, made in REDUCTIONS.items():
        if text.startswith(name):
            return rows.agg(made(F.expr(text[len(name) :])).alias("value"))
    if not text:
        raise CallError("the program is empty")
    return rows.select("_id", F.expr(text).alias("value"))


def apply_batches(engine: Engine, index: str, call: Call | None, program: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, columns: list[str]) -> DataFrame:
    """A Python program over Arrow batches of a set's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield program(b)

    return engine.matching(index, call).select(*columns).mapInArrow(run, schema)
