"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Texts are normalised (A-Z lower-cased; every ASCII character but letters and digits a gap) and joined by single
spaces, so that a window is a string between spaces. The automaton of all items' windows reads a text once; word
numbers come from offsets in the normalised text and are mapped to byte offsets of the original for the spans.

The benchmark is taken in blocks of at most BLOCK_BYTES of windows, each broadcast with a bound of its own: usually
one, else every block scans the documents and the parts of a document are put together by its row number.

Null or empty texts have no words and no hit. Items without words have no window. Items with the same window all
count; of items with one item_id the windows are pooled. Rows with the same doc_id are each judged alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.llm import common

WINDOW = 8
ITEMS = 2
#: Bytes of windows in one automaton: about 60 times as many bytes of nodes at the very most.
BLOCK_BYTES = 2 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RUN = pa.struct([("a", pa.int32()), ("b", pa.int32())])

_built: dict[int, tuple[list, ahocorasick.Automaton]] = {}


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(common.ALNUM).split() if text else []


def windows(w: list[bytes], n: int = WINDOW) -> list[bytes]:
    """Runs of n words, or the one run of fewer, each between spaces."""
    return [b" " + b" ".join(w[i : i + n]) + b" " for i in range(max(len(w) - n + 1, 1))] if w else []


def blocks(spark: SparkSession, benchmark: DataFrame, n: int = WINDOW, limit: int = BLOCK_BYTES) -> list[Broadcast]:
    """Broadcasts of (windows, numbers of their items, item_ids): as many as the size of the benchmark asks for."""
    out: list[Broadcast] = []
    held: dict[bytes, set[str]] = {}
    size = 0

    def close() -> None:
        if held:
            ids = sorted({i for s in held.values() for i in s})
            at = {x: k for k, x in enumerate(ids)}
            out.append(spark.sparkContext.broadcast([(w.decode("latin-1"), w.count(b" ") - 1, sorted(at[i] for i in s)) for w, s in held.items()] + [ids]))

    rows = benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("i"), "text")
    for row in rows.toLocalIterator():
        for w in windows(normal_words(row["text"].encode()), n):
            if w not in held:
                size += len(w)
                if size > limit and held:
                    close()
                    held, size = {}, len(w)
            held.setdefault(w, set()).add(row["i"])
    close()
    return out


def automaton(block: Broadcast) -> ahocorasick.Automaton:
    """Built once per worker and block; a worker holds one at a time."""
    entries = block.value
    if id(entries) not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for k, (w, _, _) in enumerate(entries[:-1]):
            a.add_word(w, k)
        a.make_automaton()
        _built[id(entries)] = (entries, a)
    return _built[id(entries)][1]


def scan(text: bytes | None, a: ahocorasick.Automaton, entries: list) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, hit runs of words as (first, past the last) apart from each other, and numbers of the items."""
    w = normal_words(text)
    if not w:
        return 0, [], set()
    joined = b" " + b" ".join(w) + b" "
    found = [(end, k) for end, k in a.iter(joined.decode("latin-1"))]
    if not found:
        return len(w), [], set()
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    after = np.searchsorted(gaps, [end for end, _ in found])  # words up to the space where a match ends
    runs: list[tuple[int, int]] = []
    items: set[int] = set()
    for past, (_, k) in sorted(zip(after.tolist(), found, strict=True), key=lambda x: x[0] - entries[x[1][1]][1]):
        items.update(entries[k][2])
        first = past - entries[k][1]
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], past))
        else:
            runs.append((first, past))
    return len(w), runs, items


def spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets in the original text of runs of words."""
    at = [m.span() for m in _WORD.finditer(text.lower())]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (item_ids in string order), spans (byte offsets in the text) of every row."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    parts = blocks(spark, benchmark, n, limit)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, n_words long, runs array<struct<a:int,b:int>>, items array<string>, spans array<struct<start:int,stop:int>>"
    both = _RUN
    ends = pa.struct([("start", pa.int32()), ("stop", pa.int32())])

    def of(block: Broadcast | None):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            entries = block.value if block else [[]]
            a, ids = automaton(block) if block else None, entries[-1]
            for b in batches:
                out = []
                for text in common.raw(b.column("text")):
                    words, runs, items = scan(text, a, entries) if a else (len(normal_words(text)), [], set())
                    out.append((words, [{"a": x, "b": y} for x, y in runs], sorted(ids[i] for i in items), [{"start": x, "stop": y} for x, y in spans(text, runs)] if runs else []))
                yield pa.record_batch([b.column("doc_id"), b.column("row"), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.list_(both), pa.list_(pa.string()), pa.list_(ends))))], names=["doc_id", "row", "n_words", "runs", "items", "spans"])

        return run

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of all blocks as those of one: what overlaps or meets is one run."""
        for b in batches:
            runs, bounds = [], []
            for x, y in zip(b.column("runs").to_pylist(), b.column("spans").to_pylist(), strict=True):
                out: list[tuple] = []
                for r, q in sorted(((u, v) for us, vs in zip(x, y, strict=True) for u, v in zip(us, vs, strict=True)), key=lambda z: (z[0]["a"], z[0]["b"])):
                    if out and r["a"] <= out[-1][0]["b"]:
                        out[-1][0]["b"], out[-1][1]["stop"] = max(out[-1][0]["b"], r["b"]), max(out[-1][1]["stop"], q["stop"])
                    else:
                        out.append((r, q))
                runs.append([r for r, _ in out])
                bounds.append([q for _, q in out])
            items = [sorted({i for part in x for i in part}) for x in b.column("items").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("row"), b.column("n_words"), pa.array(runs, pa.list_(both)), pa.array(items, pa.list_(pa.string())), pa.array(bounds, pa.list_(ends))], names=["doc_id", "row", "n_words", "runs", "items", "spans"])

    def covered(runs):  # noqa: ANN001, ANN202
        return F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])

    numbered = docs.select("doc_id", "text", (F.monotonically_increasing_id() if len(parts) > 1 else F.lit(0).cast("long")).alias("row"))
    if len(parts) <= 1:
        one = numbered.mapInArrow(of(parts[0] if parts else None), schema)
        return one.select("doc_id", "n_words", covered(F.col("runs")).alias("n_hit"), "items", "spans")
    numbered = common.materialize(numbered, "numbered")
    each = [numbered.mapInArrow(of(p), schema) for p in parts]
    whole = each[0]
    for e in each[1:]:
        whole = whole.unionAll(e)
    all_parts = whole.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *(F.collect_list(c).alias(c) for c in ("runs", "items", "spans")))
    one = all_parts.mapInArrow(merged, schema)
    return one.select("doc_id", "n_words", covered(F.col("runs")).alias("n_hit"), "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, limit: int = BLOCK_BYTES, items: int = 1) -> DataFrame:
    """The rows of docs with windows of fewer than `items` benchmark items, with all their columns."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    out = docs
    parts = blocks(spark, benchmark, n, limit)
    if items > 1 and len(parts) > 1:
        row = next(x for k in range(len(docs.columns) + 1) if (x := f"row_{k}") not in {c.lower() for c in docs.columns})
        numbered = common.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        found = hits(numbered.select(F.col(row).alias("doc_id"), "text"), benchmark, n, limit)
        return numbered.join(found.filter(F.size("items") >= items).select(F.col("doc_id").alias(row)), row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

    def of(block: Broadcast):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            entries, a = block.value, automaton(block)
            for b in batches:
                yield b.filter(pa.array([len(scan(x, a, entries)[2]) < items for x in common.raw(b.column("text"))], pa.bool_()))

        return run

    for p in parts:
        out = out.mapInArrow(of(p), docs.schema)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= ITEMS).alias("contaminated"))
