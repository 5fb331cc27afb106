"""Every query against a plain version of its contract, over whole generated and hard tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest_llm import documents, key_of, lower

from setwise.llm.queries import QUERIES


def run(spark, name: str, folder: str) -> list[dict]:
    query = next(q for n, q in QUERIES.items() if n.startswith(f"{name}_"))
    return [r.asDict() for r in query(spark, folder).collect()]


def same(got: list[dict], want: list[dict], columns: list[str]) -> None:
    assert Counter(key_of(r, columns) for r in got) == Counter(key_of(r, columns) for r in want)


def shares(folder: str, n: int, k: int) -> dict:
    return {i: zlib.crc32(str(i).encode()) % n == k if i is not None else False for i, _ in documents(folder)}


def test_op1_counts_as_the_library(spark, any_dir) -> None:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in documents(any_dir):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want.append({"doc_id": i, "n_bytes": len((text or "").encode()), "n_tokens": n, "over_limit": n > 1024})
    same(run(spark, "op1", any_dir), want, ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def test_op2_scores_every_row(spark, any_dir) -> None:
    got, held = run(spark, "op2", any_dir), shares(any_dir, 3, 1)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in documents(any_dir))
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held[r["doc_id"]]


def test_op2_tells_held_out_rows_apart(spark) -> None:
    folder = "/root/testdata/sf0.1"
    toxic = dict(zip(*(pq.read_table(f"{folder}/labels.parquet").column(c).to_pylist() for c in ("doc_id", "toxic")), strict=True))
    held = [(r["score"], toxic[r["doc_id"]]) for r in run(spark, "op2", folder) if r["held_out"] and r["doc_id"] in toxic]
    bad, good = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    caught, wrong = sum(s >= 0.7 for s in bad) / len(bad), sum(s >= 0.7 for s in good) / len(good)
    print(f"auc {auc:.3f}, caught {caught:.3f}, clean ones taken for toxic {wrong:.4f}")
    assert auc > 0.95 and caught > 0.7 and wrong < 0.02


def shingles(text: str | None, width: int) -> frozenset:
    w = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))) if w else frozenset()


def components(sets: list[tuple], percent: int = 80) -> list[int]:
    up = list(range(len(sets)))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    having = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            having[x].append(k)
    seen = set()
    for ks in having.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a][1] & sets[b][1])
                    if 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
                        i, j = find(a), find(b)
                        up[max(i, j)] = min(i, j)
    return [find(k) for k in range(len(sets))]


def test_op5_components(spark, any_dir) -> None:
    docs = sorted((x for x in documents(any_dir) if x[0] is not None), key=lambda x: x[0])
    sets = [(i, shingles(t, 4)) for i, t in docs]
    root = components(sets)
    want = [{"doc_id": i, "n_shingles": len(s), "component_id": docs[r][0], "kept": docs[r][0] == i} for (i, s), r in zip(sets, root, strict=True)]
    got = run(spark, "op5", any_dir)
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    same([r for r in got if r["doc_id"] is not None], want, ["doc_id", "n_shingles", "component_id", "kept"])


ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_op6_windows(spark, any_dir) -> None:
    owners = defaultdict(set)
    for r in pq.read_table(f"{any_dir}/benchmark.parquet").to_pylist():
        w = ALNUM.findall(lower(r["text"] or ""))
        for i in range(max(len(w) - 7, 1) if w else 0):
            if r["item_id"] is not None:
                owners[tuple(w[i : i + 8])].add(str(r["item_id"]))
    sizes = {len(w) for w in owners}
    want = []
    for i, text in documents(any_dir):
        w = ALNUM.findall(lower(text or ""))
        hit, items = [False] * len(w), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := owners.get(tuple(w[a : a + n])):
                    hit[a : a + n] = [True] * n
                    items |= found
        want.append({"doc_id": i, "n_words": len(w), "n_hit": sum(hit), "n_items": len(items), "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), "contaminated": len(items) >= 2})
    same(run(spark, "op6", any_dir), want, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def test_op7_counts(spark, any_dir) -> None:
    want = []
    for i, text in documents(any_dir):
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = set()
        for k in range(len(w) - 2):
            if grams[tuple(w[k : k + 3])] > 1:
                rep |= {k, k + 1, k + 2}
        want.append({"doc_id": i, "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup, "n_repeat_words": len(rep), "base_failed": len(w) < 50 or 100 * len(rep) > 50 * len(w)})
    got = run(spark, "op7", any_dir)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    same(got, want, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])


def test_op7_held_out_accuracy(spark) -> None:
    folder = "/root/testdata/sf0.1"
    quality = dict(zip(*(pq.read_table(f"{folder}/labels.parquet").column(c).to_pylist() for c in ("doc_id", "quality")), strict=True))
    from setwise.llm import common
    from setwise.llm import quality as q

    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    labels = spark.createDataFrame([(k, v) for k, v in quality.items() if k % 2], "doc_id long, label int")
    got = [r for r in q.quality(docs, q.train(docs, labels)).collect() if r["doc_id"] in quality and r["doc_id"] % 2 == 0 and not r["base_failed"]]
    good = [r["kept"] for r in got if quality[r["doc_id"]] == 1]
    bad = [r["kept"] for r in got if quality[r["doc_id"]] == 0]
    print(f"good kept {sum(good)}/{len(good)}, bad kept {sum(bad)}/{len(bad)}")
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * max(len(bad), 1)


def test_op8_base_score(spark, any_dir) -> None:
    held = shares(any_dir, 10, 0)
    end = object()
    tokens = lambda t: [*re.findall("[^\x20\x09-\x0d]+", lower(t or "")), end]
    c = Counter(x for i, t in documents(any_dir) if i is not None and not held[i] for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in documents(any_dir):
        w = tokens(t)
        want.append({"doc_id": i, "held_out": held[i], "n_tokens": len(w), "n_known": sum(c[x] > 0 for x in w), "train_tokens": n, "base_score": round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)})
    got = run(spark, "op8", any_dir)
    for r in got:
        r["base_score"] = round(r["base_score"], 4)
    near = lambda rows: sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"]) for r in rows)
    for (a, x), (b, y) in zip(near(got), near(want), strict=True):
        assert a == b and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-3)
    assert all(r["score"] <= 0 for r in got)


def test_op8_beats_the_base_on_held_out_rows(spark) -> None:
    got = [r for r in run(spark, "op8", "/root/testdata/sf0.01") if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_op9_as_the_library(spark, any_dir) -> None:
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [{"doc_id": i, "ids": tuple(lib.encode(t or ""))} for i, t in documents(any_dir)]
    got = run(spark, "op9", any_dir)
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got)
    for r in got:
        r["ids"] = tuple(r["ids"])
    same(got, want, ["doc_id", "ids"])


def test_op10_languages(spark, any_dir) -> None:
    got, held = run(spark, "op10", any_dir), shares(any_dir, 4, 2)
    texts = {i: t for i, t in documents(any_dir)}
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in documents(any_dir))
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == held[r["doc_id"]]
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(x.isalpha() for x in texts[r["doc_id"]] or ""))


def test_op10_held_out_accuracy(spark) -> None:
    folder = "/root/testdata/sf0.01"
    lang = dict(zip(*(pq.read_table(f"{folder}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "lang")), strict=True))
    got = [r for r in run(spark, "op10", folder) if r["held_out"]]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) / len(got)
    print(f"held-out accuracy {right:.3f}")
    assert right > 0.95


@pytest.mark.parametrize("name", [n.split("_")[0] for n in QUERIES])
def test_empty_tables(spark, empty_dir, name) -> None:
    assert run(spark, name, empty_dir) == []
