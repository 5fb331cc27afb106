"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The model merges pairs: in a text with a mark for each space and one in front, the adjacent symbols whose joint piece
has the highest score merge first, the leftmost of equal ones. Characters without a piece are written as bytes. The ids
are those of the model's own library; decoding restores every text that has no mark character (U+2581) of its own,
which stands for a space, as in the library.

The library itself encodes documents of up to CHUNK characters. No piece goes on past a mark that follows another
character, so what lies between such cuts is independent.

Longer documents are split into chunks, rows of their own, so that many tasks share a giant. A sequence of pieces is
the answer for a text just when each adjacent pair is the answer for its own two pieces; so an answer is a path of
weight 0 where pairs that aren't weigh minus infinity. A state at a boundary tells where the last piece that ended
at or before it ended, and how long it was (0 at a cut, where nothing before counts). Every chunk yields the matrix of
best weights from the states at its start to those at its end. Under (max, +) these combine associatively: tasks multiply
the matrices of BLOCK chunks, a prefix scan over a document's blocks and then over the chunks of each block gives the
products from either end of the text, and the one state of weight 0 at each boundary is the path's. Last, each chunk is
traced back alone, near its ends: what lies between its outermost cuts the library encodes.

Null and empty texts have no pieces, and a null doc_id is kept. Rows with the same doc_id are each encoded alone. Equal
scores merge from the left. Columns other than doc_id and text play no part. The vocabulary is a file that each executor
has at the given path.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.llm import common

CHUNK = 1 << 15
#: Chunks whose matrices one task multiplies.
BLOCK = 64
#: Pairs of pieces that a worker remembers.
REMEMBERED = 300_000
MARK = "▁"
_CUT = re.compile(f"[^{MARK}](?={MARK})")
_NONE = -np.inf


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if i not in special}
        self.id = {sp.id_to_piece(i): i for i in range(n) if i not in special}
        self.longest = max(map(len, self.score))
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.text = [b"" if i in special else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        if any(_CUT.search(p) for p in self.score):
            raise ValueError("a piece goes on past a mark after another character: units would not be independent")
        self.library = sp
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, s: str) -> list[str]:
        """The pieces of a string by merging, on a heap and a linked list."""
        n, score = len(s), self.score
        sym: list[str | None] = list(s)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[x], i, x) for i in range(n - 1) if (x := s[i : i + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            a = sym[i]
            j = nxt[i]
            if a is None or j >= n or a + sym[j] != both:
                continue  # one of the two has merged meanwhile
            sym[i], sym[j] = both, None
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (x := both + sym[k]) in score:
                    heapq.heappush(heap, (-score[x], i, x))
            h = prv[i]
            if h >= 0 and (x := sym[h] + both) in score:
                heapq.heappush(heap, (-score[x], h, x))
        return [x for x in sym if x is not None]

    def spell(self, piece: str) -> list[int]:
        """The id of a piece or, without one, the ids of the bytes of a character."""
        i = self.id.get(piece)
        return [self.byte.get(b, self.unknown) for b in piece.encode()] if i is None else [i]

    def follows(self, a: str, b: str) -> bool:
        """Whether piece b may come after piece a; after nothing, whether it is its own answer."""
        found = self.pairs.get((a, b))
        if found is None:
            found = self.merged(a + b) == ([a, b] if a else [b])
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def encode(self, text: str) -> list[int]:
        """The library's ids of a text, which it puts a mark in front of."""
        return self.library.encode(text)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One for all tasks of a worker process, with what it remembers."""
    return Vocabulary(path)


def normal(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


Nodes = dict[tuple[int, int], int]


class Chunk:
    """A stretch of a normal text, with up to 2 * longest characters before it and one after it for the states.

    A node is (where a piece ends, its length); its length is 0 at a cut and at the start of the text.
    """

    def __init__(self, v: Vocabulary, before: str, own: str, after: str):
        self.v, self.text, self.begin, self.after = v, before + own, len(before), after
        self.end = len(self.text)
        cuts = [m.end() for m in _CUT.finditer(self.text + after) if self.begin <= m.end() <= self.end]
        self.cuts = set(cuts)
        # before the chunk's start only what is close to it matters
        self.cuts |= {m.end() for m in _CUT.finditer(before + own[:1])}
        self.first, self.last = (cuts[0], cuts[-1]) if cuts else (None, None)

    def states(self, at: int) -> list[tuple[int, int]]:
        """Nodes that the state at a boundary may be, in an order that both of its chunks agree on."""
        out = []
        for e in range(at, max(at - self.v.longest, -1), -1):
            if e == 0 or e in self.cuts:
                out.append((e, 0))
            else:
                out += [(e, n) for n in range(1, min(self.v.longest, e) + 1) if n == 1 or self.text[e - n : e] in self.v.id]
        return out

    def reach(self, seeds: Nodes, stop: int) -> tuple[Nodes, dict[tuple[int, int], tuple[int, int]]]:
        """What can be reached from seeds (a node's bits tell from which) up to stop, and a predecessor of each node."""
        v, text = self.v, self.text
        at: dict[int, dict[int, int]] = {}
        for (e, n), bits in seeds.items():
            at.setdefault(e, {})[n] = bits
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for p in range(min(at, default=stop), stop):
            for n, bits in at.get(p, {}).items():
                a = text[p - n : p]
                for e in range(max(p, self.begin) + 1, min(p + v.longest, stop) + 1):
                    b = text[p:e]
                    if (e == p + 1 or b in v.id) and v.follows(a, b):
                        own = 0 if e in self.cuts else e - p
                        here = at.setdefault(e, {})
                        if own not in here:
                            back[e, own] = (p, n)
                        here[own] = here.get(own, 0) | bits
        return {(e, n): bits for e, d in at.items() for n, bits in d.items()}, back

    def matrix(self) -> np.ndarray:
        """1 where the weight from a state at the start to one at the end is 0, and 0 where it is minus infinity."""
        into, out = self.states(self.begin), self.states(self.end)
        seeds = {s: 1 << i for i, s in enumerate(into)}
        nodes, _ = self.reach(seeds, self.end if self.first is None else self.first)
        if self.first is None:
            bits = [nodes.get(s, 0) for s in out]
        else:
            head = nodes.get((self.first, 0), 0)
            tail, _ = self.reach({(self.last, 0): 1}, self.end)
            bits = [head if s in tail else 0 for s in out]
        return np.array([[b >> i & 1 for b in bits] for i in range(len(into))], np.uint8)

    def _path(self, node: tuple[int, int], to: tuple[int, int]) -> list[int]:
        """Ids of the pieces from one node to another."""
        _, back = self.reach({node: 1}, to[0])
        ends = [to[0]]
        while to != node:
            to = back[to]
            ends.append(to[0])
        return [i for a, b in zip(ends[:0:-1], ends[-2::-1], strict=True) for i in self.v.spell(self.text[a:b])]

    def trace(self, start: int, leave: int) -> bytes:
        """Ids (bytes of int32) of the pieces that end in this chunk, from the numbers of the states at both ends."""
        a, b = self.states(self.begin)[start], self.states(self.end)[leave]
        if self.first is None:
            return np.array(self._path(a, b), np.int32).tobytes()
        head, tail = (np.array(x, np.int32).tobytes() for x in (self._path(a, (self.first, 0)), self._path((self.last, 0), b)))
        within = self.text[self.first : self.last]  # starts with a mark, or is empty
        return head + np.array(self.v.encode(within[1:].replace(MARK, " ")) if within else [], np.int32).tobytes() + tail


def chunks(text: str, size: int, context: int) -> list[tuple[str, str, str]]:
    """(characters before, own characters, the next one) of each stretch."""
    return [(text[max(0, i - context) : i], text[i : i + size], text[i + size : i + size + 1]) for i in range(0, len(text), size)]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product under (max, +) of matrices that have 1 for the weight 0, and 0 for minus infinity."""
    return (a.astype(np.float32) @ b.astype(np.float32) > 0).astype(np.uint8)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, combined in pairs as a tree."""
    if len(matrices) < 2:
        return matrices
    pairs = prefixes([times(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    return [matrices[0], *(pairs[k // 2] if k % 2 else times(pairs[k // 2 - 1], matrices[k]) for k in range(1, len(matrices)))]


def boundaries(matrices: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> list[int]:
    """The number of the path's state at each matrix's start and at the end, from weights of the states at both ends."""
    forward = [first, *(times(first[None], m)[0] for m in prefixes(matrices))]
    backward = [last, *(times(last[None], m)[0] for m in prefixes([m.T for m in reversed(matrices)]))]
    return [int((f & b).argmax()) for f, b in zip(forward, reversed(backward), strict=True)]


def _one(at: int, n: int) -> np.ndarray:
    return (np.arange(n) == at).astype(np.uint8)


def _packed(m: np.ndarray) -> tuple[bytes, int, int]:
    return np.packbits(m).tobytes(), *m.shape


def _matrices(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(m, np.uint8), count=h * w).reshape(h, w) for m, h, w in zip(pdf["m"], pdf["high"], pdf["wide"], strict=True)]


def encode(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip (the ids decode to the text) of every row."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_pieces", "ids", "round_trip"]
    schema = f"doc_id {kind}, n_pieces long, ids array<int>, round_trip boolean"

    def finish(keys: pa.Array, ids: list[np.ndarray], same: list[bool]) -> pa.RecordBatch:
        n = [len(x) for x in ids]
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat, pa.int32()))
        return pa.record_batch([keys, pa.array(n, pa.int64()), lists, pa.array(same, pa.bool_())], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            ids = v.library.encode(texts)
            same = [x == y for x, y in zip(v.library.decode(ids), texts, strict=True)]
            yield finish(b.column("doc_id"), [np.array(x, np.int32) for x in ids], same)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            for key, row, text in zip(b.column("doc_id"), b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                parts = chunks(normal(text), chunk, 2 * v.longest)
                yield pa.record_batch([pa.array([key.as_py()] * len(parts), key.type), pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), *(pa.array(x) for x in zip(*parts, strict=True))], names=["doc_id", "row", "k", "before", "own", "after"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            made = []
            for r in b.select(["before", "own", "after"]).to_pylist():
                c = Chunk(v, **r)
                made.append((*_packed(c.matrix()), sum(1 for e, _ in c.states(c.end) if e == c.end)))
            columns = zip(*made, strict=True) if made else ([], [], [], [])
            yield pa.record_batch([b.column("row"), b.column("k"), *(pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True))], names=["row", "k", "m", "high", "wide", "ends"])

    def multiplied(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        m, high, wide = _packed(prefixes(_matrices(pdf))[-1])
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "block": pdf["block"].iloc[:1], "m": [m], "high": high, "wide": wide, "ends": pdf["ends"].iloc[-1]})

    def crossed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        ms = _matrices(pdf)
        at = boundaries(ms, _one(0, len(ms[0])), (np.arange(pdf["wide"].iloc[-1]) < pdf["ends"].iloc[-1]).astype(np.uint8))
        return pd.DataFrame({"row": pdf["row"], "block": pdf["block"], "first": at[:-1], "last": at[1:]})

    def combined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        ms = _matrices(pdf)
        at = boundaries(ms, _one(pdf["first"].iloc[0], len(ms[0])), _one(pdf["last"].iloc[0], pdf["wide"].iloc[-1]))
        return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "start": at[:-1], "leave": at[1:]})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            ids = [Chunk(v, r["before"], r["own"], r["after"]).trace(r["start"], r["leave"]) for r in b.to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("row"), b.column("k"), b.column("own"), pa.array(ids, pa.binary())], names=["doc_id", "row", "k", "own", "x"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for t in common.groups(batches, ["row"]):
            ids = np.frombuffer(b"".join(t["x"].to_pylist()), np.int32)
            own = "".join(t["own"].to_pylist())
            yield finish(t["doc_id"].slice(0, 1).combine_chunks(), [ids], [v.decode(ids) == own.replace(MARK, " ")[1:]])

    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = docs.filter(~long).mapInArrow(whole, schema)
    giants = docs.filter(long).withColumn("row", F.monotonically_increasing_id())
    parts = common.materialize(giants.mapInArrow(split, f"doc_id {kind}, row long, k int, before string, own string, after string").repartition("row", "k"), "chunks")
    made = parts.mapInArrow(matrices, "row long, k int, m binary, high int, wide int, ends int").withColumn("block", F.expr(f"k div {BLOCK}").cast("int"))
    made = common.materialize(made, "matrices")
    blocks = made.groupBy("row", "block").applyInPandas(multiplied, "row long, block int, m binary, high int, wide int, ends int")
    crossings = blocks.groupBy("row").applyInPandas(crossed, "row long, block int, first int, last int")
    ends = made.join(crossings, ["row", "block"]).groupBy("row", "block").applyInPandas(combined, "row long, k int, start int, leave int")
    done = parts.join(ends, ["row", "k"]).mapInArrow(traced, f"doc_id {kind}, row long, k int, own string, x binary")
    rows = done.repartition("row").sortWithinPartitions("row", "k")
    return short.unionAll(rows.mapInArrow(gather, schema))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give a null text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            texts = [None if x is None else v.decode(np.array(x, np.int32)) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
