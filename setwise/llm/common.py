"""What the operators of this subpackage share: tables, the shared work folder, word splitting."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.sources.store import shared_folder

#: Bytes of Arrow data that Python gets at once: bounds a worker's memory whatever the length of texts.
BATCH_BYTES = 16 << 20
#: States of about 10 KB that the SQL parser's cache holds in the driver, within bounded_parser().
PARSER_STATES = 1000
#: Parts that one key is dealt to, the bits of a long at most.
SALTS = 64
#: Lower-cases A-Z only and turns every other ASCII character but letters and digits into a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


@contextmanager
def bounded_parser(spark: SparkSession) -> Iterator[None]:
    """Bound what the SQL parser remembers of the expressions parsed within: else the driver holds it for good."""
    settings = {"spark.sql.parser.manageParserCaches": "true", "spark.sql.parser.parserDfaCacheFlushThreshold": str(PARSER_STATES)}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def trim(spark: SparkSession) -> bool:
    """Give back to the system what the driver's JVM has freed outside its heap, where compilers and codecs leave gaps.

    False for a JVM that can't.
    """
    jvm = spark.sparkContext._jvm
    try:
        # by reflection, for the class of the server is not open to others
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, args)
    except Py4JError:
        return False
    return True


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, frees nothing early."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/setwise-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    trim(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


def _salt(by: str) -> Column:
    return F.pmod(F.xxhash64(by, F.lit(13)), F.lit(SALTS)).cast("int")


def _dealt(right: DataFrame) -> DataFrame:
    """Each row of right once for each salt in its mask."""
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.call_function("getbit", F.col("mask"), k) == 1)
    return right.withColumn("salt", F.explode(salts)).drop("mask")


def _join_salted(left: DataFrame, dealt: DataFrame, on: str) -> DataFrame:
    # a merge, so that the driver never holds and sends one of these tables, whatever their size
    return left.join(dealt.hint("merge"), [on, "salt"]).drop("salt")


def join_hot(left: DataFrame, right: DataFrame, on: str, by: str) -> DataFrame:
    """Inner join with a right side that is unique on `on`, where one key may hold a large part of left.

    Left is dealt by the key and SALTS salts of column `by`; right comes once for each pair of them that left has. A
    mask of a key's salts, combined before its shuffle, tells the pairs. So no task gets more than a hot key's
    SALTS-th part, at any size.
    """
    left = left.withColumn("salt", _salt(by))
    masks = left.groupBy(on).agg(F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
    return _join_salted(left, _dealt(masks.join(right, on)), on)


def with_totals(left: DataFrame, on: str, by: str, *totals: Column, where: str | None = None, rows: str | None = None) -> DataFrame:
    """Left's rows (those that `rows` holds for) with aggregates over all rows of their key, where `where` holds for them.

    Dealt like join_hot(), but one aggregation gives the totals and the masks.
    """
    left = left.withColumn("salt", _salt(by))
    per = left.groupBy(on).agg(*totals, F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
    per = per.filter(where) if where else per
    return _join_salted(left.filter(rows) if rows else left, _dealt(per), on)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, as bytes: neither step touches bytes above 127."""
    return text.lower().split() if text else []


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches sorted by these keys; a group may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        ks = list(zip(*(t.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(1, len(ks) + 1):
            if i < len(ks) and ks[i] == ks[start]:
                continue
            part = t.slice(start, i - start)
            if held and ks[start] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
            last = ks[start]
            start = i
    if held:
        yield pa.concat_tables(held)
