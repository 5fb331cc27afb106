"""A small table of hard cases beside the generated one; both as folders of Parquet files."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

WORDS = [w + x for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta") for x in ("", "s", "ed", "ing", "er", "Über", "ñ")]
EXTRA = ("lang", "source", "n_chars", "row", "key", "score", "held_out", "rep", "h", "component")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def hard_documents() -> list[tuple]:
    rng = random.Random(7)
    base = sentence(rng, 120).split()
    texts: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "two words"), (7, "Two  WORDS\x0b"), (None, "no id here at all"), (None, None)]
    texts += [(10, " ".join(base)), (11, " ".join(base)), (12, " ".join(base).upper()), (13, " ".join(base))]
    for k in range(14, 40):  # near copies in a chain
        w = base[:]
        for j in range(k - 13):
            w[(j * 37) % len(w)] = f"x{j}"
        texts.append((k, " ".join(w)))
    texts += [(50, sentence(rng, 30_000)), (51, "a" * 70_000), (52, "日本語" * 15_000), (53, "line one here\n" * 60), (54, "tie tie tie tie " * 40)]
    texts += [(60, "repeated row of words " + sentence(rng, 60))] * 3
    texts += [(70 + k, sentence(rng, rng.randint(1, 200))) for k in range(40)]
    return [(i, t, ("en", "de", None)[k % 3], "s", len(t or ""), k, "k", 0.5, True, k, k, k) for k, (i, t) in enumerate(texts)]


def write(spark: SparkSession, folder: Path, docs: list[tuple]) -> str:
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row long, key string, score double, held_out boolean, rep long, h long, component long").repartition(3).write.parquet(str(folder / "documents.parquet"))
    text = {d[0]: d[1] for d in docs}
    some = [x for x in (text.get(70), text.get(75), text.get(80)) if x]
    items = [(100 + k, " ".join(x.split()[:12])) for k, x in enumerate(some)] + [(200, "two words"), (201, None), (202, "..."), (203, "one"), (203, "TIE tie"), (None, "one two")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    labels = [(d[0], d[0] % 2, int(d[0] % 5 == 0)) for d in docs if d[0] and d[0] > 9] + [(10, 1, 1), (None, 1, 0), (11, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


@pytest.fixture(scope="session")
def hard_dir(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> str:
    return write(spark, tmp_path_factory.mktemp("hard"), hard_documents())


@pytest.fixture(scope="session")
def empty_dir(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> str:
    return write(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.fixture(params=["generated", "hard"])
def any_dir(request: pytest.FixtureRequest, sf_dir: str, hard_dir: str) -> str:
    return sf_dir if request.param == "generated" else hard_dir


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
