"""Decoding, the associative combination of matrices, and chunks of many sizes."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from setwise.llm import sentence_pieces as sp

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts() -> list[str | None]:
    rng = random.Random(5)
    letters = "abcdefghijklmnop  éß日本𝄞\t\n"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    return [*out, None, "", " ", "   two  ", "\x00\x01", "a" * 3000, "ab" * 2000, "▁own ▁marks▁", " ".join(["again"] * 500)]


@pytest.mark.parametrize(("chunk", "block"), [(1 << 15, 64), (97, 3), (250, 1)])
def test_encode_and_decode(spark, monkeypatch, chunk, block) -> None:
    """As the library, whatever the chunks; decoding restores all but texts with marks of their own."""
    import sentencepiece

    monkeypatch.setattr(sp, "BLOCK", block)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate(texts()))
    encoded = sp.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, chunk)
    got = {r["doc_id"]: r for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in sp.decode(encoded, MODEL).collect()}
    for k, text in rows:
        assert got[k]["ids"] == lib.encode(text or ""), repr(text)
        assert got[k]["round_trip"] == ("▁" not in (text or ""))
        assert back[k] == (text or "").replace("▁", " ")


def test_null_ids_give_a_null_text(spark) -> None:
    assert sp.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).first()["text"] is None


def test_any_bracketing_gives_the_same() -> None:
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 16, 33):
        sizes = rng.integers(1, 6, n + 1)
        ms = [(rng.random((a, b)) < 0.6).astype(np.uint8) for a, b in zip(sizes, sizes[1:], strict=False)]
        serial = [ms[0]]
        for m in ms[1:]:
            serial.append(sp.times(serial[-1], m))
        for a, b in zip(sp.prefixes(ms), serial, strict=True):
            assert (a == b).all()


def test_merging_is_the_librarys() -> None:
    v, rng = sp.Vocabulary(MODEL), random.Random(9)
    for _ in range(500):
        w = "".join(rng.choice("etaoin shrdlu é日") for _ in range(rng.randint(1, 60)))
        assert [i for p in v.merged(sp.normal(w)) for i in v.spell(p)] == v.encode(w)
