"""Inner joins on equal keys and one inequality, by blocks of sorted rows.

A key with n rows on either side has up to n * n pairs. A sort-merge join compares all of them, one key in one task, and
holds all matches of a row at once. Here the right side is dealt by range of key and value into blocks of neighbours, and a
left row meets blocks: those with no match are left out whole, and in all but the one around its value nothing is compared.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: Right rows of a block; left rows of a key that meet a block in one task, about.
BLOCK, CELL = 1 << 11, 1 << 14
#: Pairs of equal keys for each row of the tables from which blocks pay; pairs for each task.
DENSE, TASK = 64, 1 << 26
#: Types whose order by SORT BY, min and max is that of the operators.
_ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
#: Others that rows may hold. Floats have two zeros that sort as one, so rows with them have no certain order.
_HELD = (*_ORDERED, T.BooleanType, T.BinaryType)

Side = tuple[str, str, list[str], str, list[str]]  # source, alias, keys, value, columns that are read


def _names(n: int, prefix: str = "") -> str:
    return ", ".join(f"{prefix}_k{i}" for i in range(n))


def _rows(side: Side) -> str:
    """Rows that can match: none of the keys and values is null."""
    source, _, keys, value, columns = side
    items = [f"`{c}` AS _k{i}" for i, c in enumerate(keys)] + [f"`{value}` AS _v"]
    packed = ", ".join(f"'{c}', `{c}`" for c in columns)
    return f"SELECT {', '.join(items)}, named_struct({packed}) AS _row FROM {source} WHERE {' AND '.join(f'`{c}` IS NOT NULL' for c in [*keys, value])}"


def _sizes(left: Side, right: Side) -> str:
    k = _names(len(left[2]))
    count = f"SELECT {k}, count(*) AS {{}} FROM ({{}}) GROUP BY {k}"
    return f"SELECT * FROM ({count.format('_nl', _rows(left))}) JOIN ({count.format('_nr', _rows(right))}) USING ({k})"


def _dealt(left: Side, right: Side, tasks: int) -> tuple[str, str]:
    """The left side's rows, in each of the cells of their key and part; the right side's blocks, in each part of the left rows of their key.

    Rows are sorted by all that is read of them, so that a task that is run again makes the same blocks.
    """
    k, sizes = _names(len(left[2])), _sizes(left, right)
    parts, blocks = f"cast(ceil(_nl / {CELL}) AS bigint)", f"cast(ceil(_nr / {BLOCK}) AS bigint)"
    hint = f"/*+ REPARTITION({tasks}, {k}, _part, _cell) */"
    rows = f"SELECT {hint} * FROM (SELECT {k}, _v, _row, pmod(xxhash64(_row), {parts}) AS _part, explode(sequence(0L, {blocks} - 1L)) AS _cell FROM ({_rows(left)}) JOIN ({sizes}) USING ({k}))"
    ranged = f"SELECT * FROM (SELECT /*+ REPARTITION_BY_RANGE({k}, _v, _row) */ * FROM ({_rows(right)})) SORT BY {k}, _v, _row"
    made = f"SELECT {k}, _block, min(_v) AS _low, max(_v) AS _high, collect_list(_row) AS _rows FROM (SELECT *, monotonically_increasing_id() div {BLOCK} AS _block FROM ({ranged})) GROUP BY {k}, _block"
    return rows, f"SELECT {hint} * FROM (SELECT {k}, _low, _high, _rows, explode(sequence(0L, {parts} - 1L)) AS _part, pmod(_block, {blocks}) AS _cell FROM ({made}) JOIN ({sizes}) USING ({k}))"


def _repeats(spark: SparkSession, source: str) -> bool:
    """Whether the rows of a source are the same each time they are read, as far as the plan tells."""
    plan = spark.sql(f"SELECT * FROM {source}")._jdf.queryExecution().optimizedPlan()
    return plan.deterministic() and not any(x in plan.toString() for x in ("Limit", "Sample"))


def _is(kind: T.DataType, of: tuple[type[T.DataType], ...]) -> bool:
    return isinstance(kind, of) and getattr(kind, "collation", "UTF8_BINARY") == "UTF8_BINARY"


def sql(spark: SparkSession, left: Side, op: str, right: Side) -> tuple[str, str] | None:
    """The tables of a FROM clause, and a test for WHERE, for left's value `op` right's value on equal keys.

    None if Spark's own join is as good, or for columns of other types. Counts the rows of each key, which is a job.
    """
    kinds = []
    for source, _, keys, value, columns in (left, right):
        types = {f.name: f.dataType for f in spark.sql(f"SELECT * FROM {source}").schema}
        kinds.append([types[c] for c in (*keys, value)])
        if not all(_is(x, _ORDERED) for x in kinds[-1]) or not all(_is(types[c].elementType if isinstance(types[c], T.ArrayType) else types[c], _HELD) for c in columns):
            return None
    if kinds[0] != kinds[1] or not all(_repeats(spark, x[0]) for x in (left, right)):
        return None
    pairs, rows = spark.sql(f"SELECT sum(cast(_nl AS double) * _nr), sum(cast(_nl AS double) + _nr) FROM ({_sizes(left, right)})").first()
    if not pairs or pairs < DENSE * rows:
        return None
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(pairs // TASK), 10_000))
    near, far = ("_low", "_high") if op in ("<", "<=") else ("_high", "_low")
    on = " AND ".join(f"_a.{x} = _b.{x}" for x in [*_names(len(left[2])).split(", "), "_part", "_cell"])
    p, q, (a, b) = left[1], right[1], _dealt(left, right, tasks)
    columns = ", ".join(f"_a._row.`{c}` AS `{c}`" for c in left[4])
    met = f"SELECT /*+ MERGE(_a, _b) */ {columns}, _a._v AS _range_value, _b._rows AS _range_rows, _a._v {op} _b.{near} AS _range_all FROM ({a}) AS _a JOIN ({b}) AS _b ON {on} AND _a._v {op} _b.{far}"
    return f"({met}) AS {p} LATERAL VIEW inline({p}._range_rows) {q} AS {', '.join(f'`{c}`' for c in right[4])}", f"({p}._range_all OR {p}._range_value {op} {q}.`{right[3]}`)"
