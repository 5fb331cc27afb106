"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, modulo SPACE, of its words, adjacent pairs, and pairs with one or two
words between. Each is present or absent. The learner keeps per-coordinate rates; its L1 term leaves few weights,
which are broadcast as two arrays (at most SPACE entries, so at most 12 * SPACE bytes).

Training reads at most TRAIN_ROWS labelled rows, chosen by a hash of doc_id: a documented bound, spread over the
whole table. Rows are learnt from one at a time, in hash order, in one task. Null and empty texts have no feature
and get the bias alone. Labelled rows without a text or a label are not learnt from; of several labels of one
doc_id the largest counts. Without any labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.llm import common

SPACE = 1 << 21
TRAIN_ROWS = 12_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.5
#: A toxic row counts so many times: they are the rarer class.
POSITIVE = 3.0
THRESHOLD = 0.7
REMEMBERED = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh32_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


class Features:
    """Slots of a text's n-grams and skip-grams, repeats included."""

    def __init__(self, space: int = SPACE):
        self.of, self.mask = _Hashes().__getitem__, np.uint32(space - 1)

    def slots(self, text: bytes | None) -> np.ndarray:
        w = text.translate(common.ALNUM).split() if text else []
        h = np.fromiter(map(self.of, w), np.uint32, len(w))
        mix = h * np.uint32(0x9E3779B1)
        parts = [h]
        for gap, salt in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (3, 0x27D4EB2F)):
            if len(h) > gap:
                parts.append((mix[:-gap] ^ (h[gap:] + np.uint32(salt))) * np.uint32(salt))
        x = np.concatenate(parts)
        return (x ^ (x >> np.uint32(15))) & self.mask


class Ftrl:
    """McMahan's FTRL-proximal update with a bias that is not regularised."""

    def __init__(self, space: int = SPACE, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(space + 1), np.zeros(space + 1)
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, space

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, l1 = self.z[i], np.where(i == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, label: int) -> None:
        i = np.append(np.unique(slots).astype(np.int64), self.bias)
        w = self.weights(i)
        g = (sigmoid(w.sum()) - label) * (POSITIVE if label else 1.0)
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        i = np.flatnonzero(np.abs(self.z[:-1]) > self.l1)
        return i.astype(np.int32), self.weights(i).astype(np.float64), float(self.weights(np.array([self.bias]))[0])


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from docs(doc_id, text) and labels(doc_id, label): at most `rows` rows, by hash of doc_id."""
    spark = docs.sparkSession
    chosen = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(rows)
    sample = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `rows` rows at most

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in batches:
            slots = [np.unique(f.slots(x)).tobytes() for x in common.raw(b.column("text"))]
            yield pa.record_batch([b.column("order"), b.column("label"), pa.array(slots, pa.binary())], names=["order", "label", "slots"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(y, np.frombuffer(s, np.uint32)) for b in batches for y, s in zip(b.column("label").to_pylist(), b.column("slots").to_pylist(), strict=True)]
        model = Ftrl()
        for _ in range(EPOCHS):
            for y, s in data:
                model.learn(s, y)
        i, w, bias = model.compact()
        yield pa.record_batch([pa.array([*i.tolist(), -1], pa.int32()), pa.array([*w.tolist(), bias], pa.float64())], names=["slot", "weight"])

    common.bounded_batches(spark)
    one = sample.mapInArrow(featured, "order long, label int, slots binary").repartition(1).sortWithinPartitions("order", "label", "slots")
    got = one.mapInArrow(learn, "slot int, weight double").toPandas()
    own = got["slot"] >= 0
    bias = float(got.loc[~own, "weight"].sum())
    return got.loc[own, "slot"].to_numpy(), got.loc[own, "weight"].to_numpy(), bias


def toxicity(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    model = spark.sparkContext.broadcast(weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, w, bias = model.value
        dense, f = np.zeros(SPACE, np.float32), Features()
        dense[i] = w
        for b in batches:
            scores = []
            for text in common.raw(b.column("text")):
                s = f.slots(text)
                hit = s[dense[s] != 0]
                scores.append(sigmoid(float(dense[np.unique(hit)].sum(dtype=np.float64)) + bias))
            yield pa.record_batch([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    weights = train(docs, labels.filter(common.fold("doc_id", 3) != 1))
    held_out = F.coalesce(common.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return toxicity(docs, weights).select("doc_id", held_out, "score", "predicted")
