"""Each stage of the pipeline, and the whole, against the operators' plain versions on hard rows."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from test_contracts import ALNUM, components, shingles
from conftest_llm import documents, lower

from setwise.llm import common

STAGES = dict(corpus_pipeline.STAGES)


def key(r) -> tuple:  # noqa: ANN001
    return (r["doc_id"], r["text"])


def docs_of(spark, folder: str):  # noqa: ANN001, ANN201
    return common.table(spark, folder, "documents")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_take_empty_tables(spark, hard_dir, empty_dir, name) -> None:
    for folder in (hard_dir, empty_dir):
        docs = docs_of(spark, folder)
        out = STAGES[name](spark, docs, folder)
        assert out.columns == docs.columns
        assert (out.count() == 0) == (folder == empty_dir)


def test_quality_rules(spark, hard_dir) -> None:
    """What stays is whole, and nothing that fails the base rule stays."""
    docs = docs_of(spark, hard_dir)
    kept = [key(r) for r in STAGES["quality rules"](spark, docs, hard_dir).collect()]
    assert not Counter(kept) - Counter(key(r) for r in docs.collect())
    for _, text in kept:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        assert len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)


def test_near_duplicates(spark, hard_dir) -> None:
    """The smallest doc_id of each component of five-word shingles stays; equal rows leave one."""
    docs = docs_of(spark, hard_dir)
    rows = sorted({x for x in documents(hard_dir) if x[0] is not None}, key=lambda x: (x[0] != 60, x[0]))  # a repeated id comes first
    root = components([(i, shingles(t, 5)) for i, t in rows])
    want = [x for x, k, r in zip(rows, range(len(rows)), root, strict=True) if k == r] + [x for x in documents(hard_dir) if x[0] is None]
    assert Counter(key(r) for r in STAGES["near-duplicates"](spark, docs, hard_dir).collect()) == Counter(want)


def test_decontamination(spark, hard_dir) -> None:
    items = [ALNUM.findall(lower(r["text"])) for r in common.table(spark, hard_dir, "benchmark").filter("item_id is not null and text is not null").collect()]
    windows = {tuple(w[i : i + 8]) for w in items if w for i in range(max(len(w) - 7, 1))}

    def clean(text: str | None) -> bool:
        w = ALNUM.findall(lower(text or ""))
        return not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    docs = docs_of(spark, hard_dir)
    assert Counter(key(r) for r in STAGES["decontamination"](spark, docs, hard_dir).collect()) == Counter(x for x in documents(hard_dir) if clean(x[1]))


def test_pii(spark, hard_dir) -> None:
    """Every row stays; with the columns' names that the operator uses itself, too."""
    plain = spark.createDataFrame([(1, "Mr. Quigley 10.1.2.3", 9), (2, None, 9), (2, "clean", 9)], "doc_id long, text string, n_entities int")
    got = {(r["doc_id"], r["text"] is None): r for r in STAGES["PII"](spark, plain, hard_dir).collect()}
    assert len(got) == 3 and {r["n_entities"] for r in got.values()} == {9} and got[2, False]["text"] == "clean"
    assert re.fullmatch(r"Mr\. [A-Z][a-z]+ \d+\.\d+\.\d+\.\d+", got[1, False]["text"]) and "Quigley" not in got[1, False]["text"]


def test_whole_pipeline(spark, hard_dir) -> None:
    """run() gives what the stages give one after the other, and pieces of what they left."""
    import sentencepiece

    folder = hard_dir
    docs = docs_of(spark, folder)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, folder), "test")
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], tuple(lib.encode(r["text"] or ""))) for r in docs.collect())
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want and want


def test_run_on_empty_tables(spark, empty_dir) -> None:
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
