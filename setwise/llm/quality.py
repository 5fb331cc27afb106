"""Quality rules: counts of a document, a base rule, and gradient-boosted trees over its statistics.

Trees are fitted to labels by second-order boosting on histograms, with monotonic constraints: symbols, repeated
words, repeated lines, capitals and digits can only lower a verdict. They are flattened into numpy node arrays that
score all rows of a batch level by level. The model is a few kilobytes.

Training uses at most TRAIN_ROWS labelled rows, chosen by a hash of doc_id (a documented bound); only their
statistics reach the driver. Null and empty texts count as having no word and fail the base rule. Of several labels
of one doc_id the largest counts. Without both classes among the labels the base rule decides alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.llm import common

TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, L2, MIN_ROWS = 40, 3, 0.2, 64, 1.0, 20
#: A document is kept at this probability of quality or more: junk goes, doubtful documents stay.
THRESHOLD = 0.35
SYMBOLS = tuple(b"#*$%&|<>")
#: Statistics in order, with the direction that each may move the verdict: -1 down, 0 any.
STATISTICS = (("log_words", 0), ("mean_word", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("capital_share", -1), ("digit_share", -1), ("mark_share", 0), ("distinct_share", 0), ("short_line_share", 0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES, _CAPITALS, _DIGITS, _MARKS = b" \t\n\x0b\x0c\r", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?"
_CONTINUED = bytes(range(0x80, 0xC0))


def measure(text: bytes | None) -> tuple[tuple[int, ...], list[float]]:
    """The counts of the contract and the statistics of one text."""
    if not text:
        return (0, 0, 0, 0, 0), [0.0] * len(STATISTICS)
    w = text.split()
    n = len(w)
    chars = len(text.translate(None, _SPACES + _CONTINUED))
    size = len(text)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    dup = short = filled = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(_SPACES):
            seen.add(line)
        else:
            continue
        filled += 1
        short += len(line) < 30
    repeat, distinct = 0, 0
    if n:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, n)
        distinct = len(number)
        if n > 2:
            m = len(number)
            if m < 2_000_000:
                key = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
                _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            else:
                _, back, count = np.unique(np.stack((ids[:-2], ids[1:-1], ids[2:]), 1), axis=0, return_inverse=True, return_counts=True)
            twice = count[back.ravel()] > 1
            hit = np.zeros(n, bool)
            hit[:-2] = twice
            hit[1:-1] |= twice
            hit[2:] |= twice
            repeat = int(hit.sum())
    caps = size - len(text.translate(None, _CAPITALS))
    digits = size - len(text.translate(None, _DIGITS))
    marks = size - len(text.translate(None, _MARKS))
    c = max(chars, 1)
    stats = [float(np.log1p(n)), chars / max(n, 1), symbols / c, dup / max(filled, 1), repeat / max(n, 1), caps / c, digits / c, marks / c, distinct / max(n, 1), short / max(filled, 1)]
    return (n, chars, symbols, dup, repeat), stats


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


class Trees:
    """Boosted trees as flat arrays: feature (-1 at leaves), threshold, left child (right is the next), value."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, value: np.ndarray, roots: np.ndarray, start: float):
        self.feature, self.threshold, self.left, self.value, self.roots, self.start = feature, threshold, left, value, roots, start

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows: every tree steps all rows down one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[at]
            go = self.left[at] + (x[row, np.maximum(f, 0)] > self.threshold[at])
            at = np.where(f < 0, at, go)
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = tuple(d for _, d in STATISTICS)) -> Trees | None:
    """Fit trees to rows x and labels y; None unless both labels occur."""
    if not len(y) or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    # each class weighs the same, so that a rare one is learnt too
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    feature, threshold, left, value, roots = [], [], [], [], []
    margin = np.zeros(len(y))

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float, at: int) -> None:
        def best(gs: float, hs: float) -> float:
            return float(np.clip(-gs / (hs + L2), low, high))

        total_g, total_h = g[rows].sum(), h[rows].sum()
        value[at] = RATE * best(total_g, total_h)
        if depth == DEPTH or len(rows) < 2 * MIN_ROWS:
            return
        gain_most, chosen = 1e-6, None
        for j, e in enumerate(edges):
            b = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
            gr, hr = total_g - gl, total_h - hl
            vl, vr = np.clip(-gl / (hl + L2), low, high), np.clip(-gr / (hr + L2), low, high)

            def loss(gs, hs, v):  # noqa: ANN001, ANN202
                return -(gs * v + 0.5 * (hs + L2) * v * v)

            v = best(total_g, total_h)
            gain = loss(gl, hl, vl) + loss(gr, hr, vr) - loss(total_g, total_h, v)
            gain[(nl < MIN_ROWS) | (len(rows) - nl < MIN_ROWS) | (monotone[j] * (vr - vl) < 0)] = -1
            if len(gain) and gain.max() > gain_most:
                k = int(gain.argmax())
                gain_most, chosen = gain[k], (j, k, vl[k], vr[k])
        if chosen is None:
            return
        j, k, vl, vr = chosen
        feature[at], threshold[at], left[at] = j, edges[j][k], len(feature)
        for array, empty in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            array += [empty, empty]
        goes = binned[rows, j] <= k
        middle = (vl + vr) / 2
        bounds = ((low, high), (low, high)) if not monotone[j] else ((middle, high), (low, middle)) if monotone[j] < 0 else ((low, middle), (middle, high))
        here = left[at]
        node(rows[goes], g, h, depth + 1, *bounds[0], here)
        node(rows[~goes], g, h, depth + 1, *bounds[1], here + 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        roots.append(len(feature))
        for array, empty in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            array.append(empty)
        node(np.arange(len(y)), weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf, roots[-1])
        one = Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots[-1:]), 0.0)
        step = one.score(x)
        margin += np.log(step / (1 - step))
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), 0.0)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees from docs(doc_id, text) and labels(doc_id, label): at most `rows` rows by hash of doc_id."""
    common.bounded_batches(docs.sparkSession)
    chosen = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [measure(x)[1] for x in common.raw(b.column("text"))]
            yield pa.record_batch([b.column("order"), b.column("label"), pa.array(stats, pa.list_(pa.float64()))], names=["order", "label", "stats"])

    sample = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `rows` rows at most
    got = sample.mapInArrow(run, "order long, label int, stats array<double>").toPandas()
    if got.empty:
        return None
    x, y, order = np.array(got["stats"].tolist()), got["label"].to_numpy(), got["order"].to_numpy()
    by = np.lexsort((*x.T, y, order))
    return fit(x[by], y[by])


def measured(batch: pa.RecordBatch, trees: Trees | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base verdicts and whether to keep, for each row of a batch with a text column."""
    both = [measure(x) for x in common.raw(batch.column("text"))]
    counts = np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS))
    failed = np.array([base_failed(c[0], c[4]) for c, _ in both], bool)
    keep = ~failed
    if trees is not None and len(both):
        keep &= trees.score(np.array([s for _, s in both])) >= threshold
    return counts, failed, keep


def quality(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    model = spark.sparkContext.broadcast(trees)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, failed, keep = measured(b, model.value, threshold)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(keep)], names=["doc_id", *COUNTS, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    model = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(measured(b, model.value, threshold)[2]))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality(docs, train(docs, labels))
