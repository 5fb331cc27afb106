"""One automaton and many give the same."""

from __future__ import annotations

import random

import pytest

from setwise.llm import common, decontamination


def tables(spark):  # noqa: ANN001, ANN201
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 12, 20])))) for k in range(40)]
    docs = []
    for k in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        docs.append((k % 50, "; ".join([parts[0], rng.choice(items)[1].upper(), parts[1], rng.choice(items)[1], parts[2]][: rng.randint(0, 5)]), k))
    docs += [(None, items[0][1], 1), (7, None, 2), (8, "", 3)]
    return spark.createDataFrame(docs, "doc_id long, text string, row_0 int"), spark.createDataFrame(items, "item_id long, text string")


def test_any_number_of_blocks_gives_the_same_hits(spark) -> None:
    docs, benchmark = tables(spark)
    assert len(decontamination.blocks(spark, benchmark, limit=300)) > 5
    one, many = (sorted((tuple(map(str, r)) for r in decontamination.hits(docs, benchmark, limit=x).collect())) for x in (1 << 20, 300))
    assert one == many


@pytest.mark.parametrize("items", [1, 2])
def test_any_number_of_blocks_leaves_the_same_rows(spark, items) -> None:
    docs, benchmark = tables(spark)
    one, many = (decontamination.clean(docs, benchmark, limit=x, items=items) for x in (1 << 20, 300))
    assert one.columns == many.columns == docs.columns
    rows = sorted(map(str, many.collect()))
    assert rows == sorted(map(str, one.collect())) and len(rows) < docs.count()
    bad = [len(r["items"]) for r in decontamination.hits(docs, benchmark).collect()]
    assert len(rows) == sum(n < items for n in bad)


def test_spans_are_offsets_in_the_text(spark) -> None:
    docs = spark.createDataFrame([(1, "Äh: ONE two, é three!")], "doc_id long, text string")
    r = decontamination.hits(docs, spark.createDataFrame([(1, "one TWO")], "item_id long, text string")).first()
    assert "Äh: ONE two, é three!".encode()[r["spans"][0]["start"] : r["spans"][0]["stop"]] == b"ONE two" and common.ALNUM
