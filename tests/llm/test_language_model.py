"""The n-gram trie against a plain model with dictionaries, and its parts against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from setwise.llm import language_model as lm


def plain(train: list[str], texts: list[str]) -> list[float]:
    tokens = lambda t: [*re.findall("[^\x20\x09-\x0d]+", t.lower()), "\n"]
    grams = {k: Counter(tuple(w[i : i + k]) for t in train for w in [tokens(t)] for i in range(len(w) - k + 1)) for k in (1, 2, 3)}
    n, v = sum(grams[1].values()), len(grams[1])

    def p(w: str, context: tuple) -> float:
        if not context:
            return (grams[1][w,] + lm.ADD) / (n + lm.ADD * (v + 1))
        much = {1: lm.M2, 2: lm.M3}[len(context)]
        return (grams[len(context) + 1][*context, w] + much * p(w, context[1:])) / (grams[len(context)][context] + much)

    return [sum(math.log10(p(x, tuple(w[max(i - 2, 0) : i]))) for i, x in enumerate(w)) for t in texts for w in [tokens(t)]]


@pytest.mark.parametrize("split", [False, True])
def test_scores_as_the_plain_model(spark, monkeypatch, split) -> None:
    """Within the steps of quantising, with contexts split or not, in chunks of few rows and several shards."""
    if not split:
        monkeypatch.setattr(lm, "SAMPLE_ROWS", 0)
    monkeypatch.setattr(lm, "CHUNK_ROWS", 7)
    monkeypatch.setattr(lm, "SHARD", 8)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))) for _ in range(90)] + ["", " \n ", "A b\tC", "x" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") < 60).collect()}
    for k, want in enumerate(plain(texts[:60], texts)):
        assert math.isclose(got[k]["score"], want, abs_tol=2e-4 * got[k]["n_tokens"])


def test_every_ngram_stays_at_every_size(spark) -> None:
    """A trigram that occurs once counts among two million tokens."""
    docs = spark.range(700).select((F.col("id") + 10).alias("doc_id"), F.lit("x y z " * 1000).alias("text")).unionAll(spark.createDataFrame([(1, "seldom heard words"), (2, "seldom heard words")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in lm.score(docs, F.col("doc_id") != 2).filter("doc_id < 3").collect()}
    total = got[1]["train_tokens"]
    assert total > 2 << 20 and got[1]["score"] == got[2]["score"]
    p1 = (1 + lm.ADD) / (total + lm.ADD * 8)
    p2 = (1 + lm.M2 * p1) / (1 + lm.M2)
    p2_end = (1 + lm.M2 * 0) / (1 + lm.M2)
    want = math.log10(p1) + math.log10(p2) + math.log10((1 + lm.M3 * p2) / (1 + lm.M3)) + math.log10((1 + lm.M3 * p2_end) / (1 + lm.M3))
    assert math.isclose(got[1]["score"], want, abs_tol=2e-3)


def test_elias_fano_keeps_its_sequence() -> None:
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1, 2**64 - 1), (5, 3), (1000, 10), (1000, 2**37), (999, 2**63), (64, 64)):
        v = np.sort(rng.integers(0, top, n, np.uint64, endpoint=True))
        assert lm.EliasFano(*lm.mapped(lm.flat(lm.EliasFano.pack(v)))).values().tolist() == v.tolist()


def test_words_are_cut_and_hashed_alike_everywhere(monkeypatch) -> None:
    rng = random.Random(2)
    texts = ["".join(rng.choice("aAbB é\n\t\x0b ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    data, seen = [t.encode() for t in texts], {}
    for segment in (1 << 20, 8):
        monkeypatch.setattr(lm, "_SEGMENT", segment)
        t = lm.Tokens(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))))
        words = [w for x in data for w in [*x.lower().split(), b"\n"]]
        assert t.lengths.tolist() == [len(x.split()) + 1 for x in data]
        for w, h in zip(words, t.one.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_find_in_a_trie() -> None:
    rng = np.random.default_rng(3)
    contexts, follow = rng.integers(0, 50, 2000, np.uint64), rng.integers(0, 40, 2000, np.uint32)
    count = rng.integers(0, 3, 2000)
    plain_c3, plain_c2 = Counter(), Counter()
    for c, f, n in zip(contexts.tolist(), follow.tolist(), count.tolist(), strict=True):
        plain_c3[c, f] += n
        plain_c2[c] += n
    t = lm.Trie(lm.Trie.pack(contexts, follow, count))
    ask = np.arange(60, dtype=np.uint64)
    beta, alpha = t.find(ask, np.full(60, 45), np.tile(np.arange(45, dtype=np.uint32), 60))
    for c in range(60):
        assert beta[c] == lm.code(np.array([lm.M3 / (plain_c2[c] + lm.M3)]))[0]
        for f in range(45):
            n = plain_c3[c, f]
            assert alpha[c * 45 + f] == (lm.code(np.array([n / (plain_c2[c] + lm.M3)]))[0] if n else lm.ABSENT)
