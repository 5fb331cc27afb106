"""Token counts by byte-pair merging on a heap and a linked list.

A text splits into pieces by the pattern of byte-level BPE. A piece starts as its bytes; the adjacent pair of
lowest rank merges, again and again, until none has a rank. The count of a piece is its bytes minus its merges:
no identifiers are made. A text's special strings count as one token each, as the library's default has it.

Null texts count as empty: 0 bytes, 0 tokens. Any length of text and of piece works (n log n); a piece's count is
remembered in a bounded table per worker. Rows are independent, so ties, repeats and extra columns change nothing.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.llm import common

SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pieces up to REMEMBERED_BYTES are remembered, REMEMBERED of them at once.
REMEMBERED, REMEMBERED_BYTES = 400_000, 48
LIMIT = 1024


class MergeRanks:
    """The ranks of a byte-level BPE file: symbols are bytes, then one per merge, numbered by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        symbol = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[symbol[a] << 20 | symbol[b]] = rank
            symbol.setdefault(a + b, 256 + rank)

    def count(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        ranks, sym = self.ranks, list(piece)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get(sym[i] << 20 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has merged meanwhile
            sym[i], sym[j] = 256 + rank, -1
            left -= 1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (r := ranks.get(sym[i] << 20 | sym[k])) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            h = prv[i]
            if h >= 0 and (r := ranks.get(sym[h] << 20 | sym[i])) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return left


class _Counts(dict):
    """Piece to count, bounded: emptied when full."""

    def __init__(self, ranks: MergeRanks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        b = piece.encode()
        n = self.ranks.count(b)
        if len(b) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


class Counter:
    def __init__(self, path: str):
        ranks = MergeRanks(path)
        self.of = _Counts(ranks).__getitem__
        self.pieces = regex.compile(SPLIT).findall
        self.special = regex.compile("|".join(map(regex.escape, ranks.special))) if ranks.special else None

    def count(self, text: str) -> int:
        if self.special is not None and any(self.special.finditer(text)):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(map(self.of, self.pieces(x))) for x in parts)
        return sum(map(self.of, self.pieces(text)))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; tokenizer is a file that each executor has at this path."""
    common.bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            n = [counter.count(x) for x in texts]
            size = [len(x.encode()) for x in texts]
            yield pa.record_batch([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
