"""Ingest as a stream: every micro-batch is an upsert into a store, and a batch that is seen again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from setwise.operators import writes
from setwise.sources.store import Store


def ingest(stream: DataFrame, store: Store, table: str, checkpoint: str, delete: bool = False, **trigger: object) -> StreamingQuery:
    """Upsert (or delete, by `_id`) the rows of a stream of files, Kafka or any other source."""

    def batch(rows: DataFrame, number: int) -> None:
        t = store.table(table)
        new = writes.delete(t, rows) if delete else writes.upsert(t, writes.check_rows(rows, store.limits(table)))
        store.write(table, new, (checkpoint, number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def kafka(spark, servers: str, topic: str, schema: str, **options: str) -> DataFrame:  # noqa: ANN001
    """Rows of a topic of JSON values; needs Spark's Kafka package."""
    from pyspark.sql import functions as F

    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")
