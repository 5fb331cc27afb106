"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIM entries +1 or -1, made from its code point. The vector of a letter trigram
binds (multiplies) its letters' vectors, the first permuted twice and the second once; a run of other characters
stands as one boundary letter. A document bundles (adds) the vectors of its trigrams; a language's prototype bundles
its documents' vectors, each at unit length, less the mean over languages, which all texts share. The document with
the same mean taken off is compared by cosine; score = (1 + cosine) / 2.

Learning sends one vector of DIM numbers per language and task, summed before any shuffle: its size follows the
number of languages, not the documents. Ties go to the first language by name. A text without a letter, empty or
null, gets `und` and score 0; without any language learnt every text does. Rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.llm import common

DIM = 1024
#: Trigram vectors kept at once in a worker, of DIM bytes each.
REMEMBERED = 48_000


class Encoder:
    """Texts to bundled vectors."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letter = np.full(0x110000, -1, np.int32)  # code point to letter number: -1 not seen yet, 0 not a letter
        self.vectors = [self._random(0)]
        self._forget()

    def _random(self, code: int) -> np.ndarray:
        return (np.random.default_rng(0x5EED + code).integers(0, 2, self.dim, np.int8) * 2 - 1).astype(np.int8)

    def _forget(self) -> None:
        self.keys, self.rows, self.table, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((REMEMBERED, self.dim), np.int8), 0

    def letters(self, text: str) -> np.ndarray:
        """Letter numbers of the text in lower case, runs of other characters as one 0, with a 0 at both ends."""
        code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        n = self.letter[code]
        if (n < 0).any():
            for c in np.unique(code[n < 0]).tolist():
                self.letter[c] = 0
                if chr(c).isalpha():
                    self.letter[c] = len(self.vectors)
                    self.vectors.append(self._random(c))
            n = self.letter[code]
        n = np.concatenate(([0], n, [0]))
        return n[(n != 0) | np.concatenate(([True], n[:-1] != 0))]

    def _of(self, grams: np.ndarray) -> np.ndarray:
        """Rows of the table for distinct trigrams, bound now if they are new."""
        at = np.searchsorted(self.keys, grams)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == grams[known]
        new = grams[~known]
        if len(new):
            if self.used + len(new) > REMEMBERED:
                self._forget()
                new = grams
            if len(new) > REMEMBERED:
                return self._bind(new)
            rows = np.arange(self.used, self.used + len(new))
            self.table[rows] = self._bind(new)
            self.used += len(new)
            keys, of = np.concatenate((self.keys, new)), np.concatenate((self.rows, rows))
            order = np.argsort(keys)
            self.keys, self.rows = keys[order], of[order]
            at = np.searchsorted(self.keys, grams)
        return self.table[self.rows[at]]

    def _bind(self, grams: np.ndarray) -> np.ndarray:
        v = np.stack(self.vectors)
        a, b, c = grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF
        return np.roll(v[a], 2, 1) * np.roll(v[b], 1, 1) * v[c]

    def encode(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a text; None without a letter."""
        if not text:
            return None
        n = self.letters(text).astype(np.int64)
        if len(n) < 3 or not n.any():
            return None
        grams, count = np.unique(n[:-2] << 42 | n[1:-1] << 21 | n[2:], return_counts=True)
        x = np.zeros(self.dim, np.float32)
        for i in range(0, len(grams), 4096):  # bounds the rows at hand for very long texts
            x += count[i : i + 4096].astype(np.float32) @ self._of(grams[i : i + 4096]).astype(np.float32)
        return x / (np.linalg.norm(x) or 1)


def learn(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their unit prototypes, and the shared mean, from docs(text, lang)."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, sums = Encoder(dim), {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if (x := e.encode(text)) is not None:
                    s = sums.setdefault(lang, np.zeros(dim + 1))
                    s[:-1] += x
                    s[-1] += 1
        if sums:
            yield pa.record_batch([pa.array([k for k in sums for _ in range(dim + 1)], pa.string()), pa.array([*range(dim + 1)] * len(sums), pa.int32()), pa.array(np.concatenate([*sums.values()]), pa.float64())], names=["lang", "i", "x"])

    got = docs.filter("lang is not null and text is not null").select("text", "lang").mapInArrow(run, "lang string, i int, x double")
    got = got.groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas()
    langs = sorted(got["lang"].unique())
    sums = np.zeros((len(langs), dim + 1))
    sums[[langs.index(x) for x in got["lang"]], got["i"]] = got["x"]
    means = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
    mean = means.mean(0) if len(langs) > 1 else np.zeros(dim)
    p = means - mean
    return langs, p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12), mean


def language_id(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes, mean = shared.value
        e = Encoder(prototypes.shape[1] if len(langs) else DIM)
        for b in batches:
            pred, score = [], []
            for text in b.column("text").to_pylist():
                x = e.encode(text) if langs else None
                if x is None:
                    pred.append("und")
                    score.append(0.0)
                    continue
                y = x - mean
                cos = prototypes @ (y / (np.linalg.norm(y) or 1))
                k = int(np.argmax(cos))
                pred.append(langs[k])
                score.append(float(np.clip((1 + cos[k]) / 2, 0, 1)))
            yield pa.record_batch([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(common.fold("doc_id", 4) != 2))
    held_out = F.coalesce(common.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return language_id(docs, model).select("doc_id", held_out, "lang_pred", "score")
