"""Groups of more members than a block, which meet block by block."""

from __future__ import annotations

import random

import pytest
from test_contracts import components, shingles

from setwise.llm import near_dedup


@pytest.mark.parametrize(("members", "width"), [(3, 4), (7, 5)])
def test_groups_of_many_blocks(spark, monkeypatch, members, width) -> None:
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", members)
    rng = random.Random(3)
    docs = []
    for g in range(6):
        base = [f"w{rng.randint(0, 10_000)}" for _ in range(60)]
        for _ in range(25):  # a chain: each is close to the one before, the ends are far apart
            if rng.random() < 0.7:
                base = base[:]
                base[rng.randrange(60)] = f"v{rng.randint(0, 10_000)}"
            docs.append((len(docs) * 3 % 1009, " ".join(base)))
    rng.shuffle(docs)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(spark.createDataFrame(docs, "doc_id long, text string"), width).collect()}
    docs.sort()
    root = components([(i, shingles(t, width)) for i, t in docs])
    assert got == {i: docs[r][0] for (i, _), r in zip(docs, root, strict=True)}


def test_keep_one(spark) -> None:
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(5, text, 1), (3, text + " x", 2), (3, text + " x", 2), (9, "alone", 3), (None, text, 4), (7, None, 5)], "doc_id long, text string, component_id int")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in kept.collect()) == [(False, 3, 2), (False, 7, 5), (False, 9, 3), (True, None, 4)]


def test_rows_of_one_id(spark) -> None:
    """An id with two texts links what is close to either; keep_one takes its texts one by one."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    docs = spark.createDataFrame([(5, a), (3, a + " x"), (5, b), (4, b), (5, b), (6, c), (None, a)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(docs).collect()}
    assert got == {5: 3, 3: 3, 4: 3, 6: 6, None: None}
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (5, b), (6, c), (None, a)], key=str)
