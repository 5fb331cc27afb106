"""LM scoring by an Elias-Fano n-gram trie that is dealt in shards, learnt and asked in one exchange.

The model has every word, bigram and trigram of the training texts, at every size of the corpus; none is pruned. With
counts c, N tokens and V distinct ones, p(w) = (c + 0.1) / (N + 0.1 (V + 1)), and longer contexts smooth by pseudo-counts:
p(w | v) = (c(v w) + M2 p(w)) / (c(v) + M2), p(w | u v) = alpha + beta p(w | v), where the trie keeps
alpha = c(u v w) / (c(u v) + M3) with the trigram and beta = M3 / (c(u v) + M3) with its context. Each sums to 1 over w.

1. Rows are taken in chunks of bounded bytes. A chunk sends the distinct words and trigrams of its texts, with their
   counts in training rows, to shards by the hash of the word or of the context: one block a shard, contexts in
   Elias-Fano form. So a frequent n-gram goes out once a chunk, and trigrams of one context meet in one shard.
2. A shard sums the counts and builds its levels in one flat buffer that is mapped, not parsed: contexts as an
   Elias-Fano sequence, pointers from each to its first successor as another, successors relative to their context as
   a third, and alpha and beta in 16 bits (steps of 1/5000 in log10). It answers each block by successor search, for the
   context and then among what its two pointers enclose. Counts of words are exact.
3. The answers meet the texts of their chunk again.

A context's key has REST bits beyond its shard, so that an unseen one is taken for a seen one with odds of about 1e-5 at
any size; words have 64 bits. Contexts that hold much of a sample's tokens are split: each of their trigrams is a context
of its own, and one entry a chunk counts the context. This routes them only; counts are the same with and without it.

Chunks are made in the order of a partition's rows, twice: `docs` must read alike each time, as tables do.

Null and empty texts have the end token alone. A null doc_id is neither learnt from nor held out. Repeated rows are
scored alike, each alone; ties don't matter. Without training rows N and V are 0 and every token has probability 1.
Columns of the input other than those asked for play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setwise.llm import common

ADD, M2, M3 = 0.1, 20.0, 3.0
#: Bytes of text and rows of a chunk, and bytes of text for which there is one shard, as a power of two.
CHUNK_BYTES, CHUNK_ROWS, SHARD = 4 << 20, 8192, 23
#: Bits of a context's key beyond its shard, and of a successor's.
REST, NEXT = 37, 24
#: Steps of log10 for quantised values; the largest code stands for a successor that isn't there.
STEPS, ABSENT = 5000, 0xFFFF
#: Rows looked at for contexts to split: those with a share of 1/SPLIT of their bigrams.
SAMPLE_ROWS, SPLIT = 20_000, 256

_SEGMENT = 1 << 20
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_END = _U(0x7F4A7C159E3779B9)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def spread(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of h (in place)."""
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xCA5A826395121157), (32, 1)):
        h ^= h >> _U(shift)
        h *= _U(factor)
    return h


def _letters() -> np.ndarray:
    out = spread(np.arange(1, 257, dtype=_U) * _U(_ODD))
    out[65:91] = out[97:123]
    return out


_LETTER = _letters()


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as many as were needed."""

    base, inverse = _U(0xD1342543DE82EF95), _U(pow(0xD1342543DE82EF95, -1, 1 << 64))
    up = down = np.ones(1, _U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.concatenate(([_U(1)], np.full(n - 1, x)))) for x in (cls.base, cls.inverse))
        return cls.up, cls.down


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words in bytes: polynomials in the place in the word, A-Z like a-z."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + _SEGMENT, "right")), i + 1)
        begin, end = int(starts[i]), int(ends[j - 1])
        up, down = _Powers.of(max(end - begin, _SEGMENT))
        sums = np.zeros(end - begin + 1, _U)
        np.cumsum(_LETTER[data[begin:end]] * up[: end - begin], out=sums[1:])
        s = starts[i:j] - begin
        out[i:j] = (sums[ends[i:j] - begin] - sums[s]) * down[s]
        i = j
    return spread(out)


def pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered pairs."""
    return spread(u * _U(0xA24BAED4963EE407) + (v ^ v >> _U(31)) * _U(_ODD))


class Tokens:
    """Token hashes of texts in a row, each with an end, and the contexts of two tokens that end at each but a text's first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        word = ~_SPACE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner], after[inner - 1] = False, False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        n = np.diff(np.searchsorted(starts, offsets))
        self.lengths = n + 1
        stop = np.cumsum(self.lengths) - 1
        self.begin = stop - n
        self.one = np.empty(len(starts) + len(n), _U)
        self.one[stop] = _END
        is_word = np.ones(len(self.one), bool)
        is_word[stop] = False
        self.one[is_word] = word_hashes(data, starts, ends)
        inside = np.ones(len(self.one), bool)
        inside[self.begin] = False
        #: Places that end a context, its hash, and the key of what follows it, 0 for nothing.
        self.at = np.flatnonzero(inside)
        self.context = pair(self.one[self.at - 1], self.one[self.at])
        follow = np.zeros(len(self.one), _U)
        follow[:-1] = np.maximum(self.one[1:] >> _U(64 - NEXT), _U(1))
        follow[stop] = 0
        self.follow = follow[self.at]


def sorted_places(keys: np.ndarray) -> np.ndarray:
    """argsort, by sorting keys joined with their places where 64 bits hold both; equal keys stay in order."""
    n = len(keys)
    width = max(n - 1, 1).bit_length()
    if n and int(keys.max()).bit_length() + width <= 64:
        return (np.sort(keys << _U(width) | np.arange(n, dtype=_U)) & _U((1 << width) - 1)).astype(np.int64)
    return np.argsort(keys, kind="stable")


def firsts(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


class Asked:
    """The distinct contexts of a chunk in order, its distinct trigrams in their order, and its distinct words."""

    def __init__(self, t: Tokens, bits: int, split: np.ndarray):
        context, follow, places = t.context, t.follow, t.at
        self.split = np.zeros(0, np.int64)
        if len(split):
            near = np.minimum(np.searchsorted(split, context), len(split) - 1)
            self.split = np.flatnonzero(split[near] == context)
            own = context.copy()
            own[self.split] = pair(context[self.split], follow[self.split])
            context, follow, places = np.concatenate((own, context[self.split])), np.concatenate((follow, np.zeros(len(self.split), _U))), np.concatenate((places, places[self.split]))
        key = context >> _U(64 - bits)
        by = sorted_places(key)
        rank = np.cumsum(firsts(key[by])) - 1
        full = rank.astype(_U) << _U(NEXT) | follow[by]
        again = sorted_places(full)
        by, full = by[again], full[again]
        new = firsts(full)
        #: For each place (those of split contexts once more at the end): its trigram, and its context.
        self.gram, self.of = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        self.gram[by], self.of[by] = np.cumsum(new) - 1, rank
        self.starts = np.flatnonzero(new)
        self.by, self.places = by, places[by]
        head = np.flatnonzero(firsts(rank))
        self.contexts = key[by[head]]
        self.follow = (full[self.starts] & _U((1 << NEXT) - 1)).astype(np.uint32)
        self.sizes = np.diff(np.append(np.searchsorted(self.starts, head), len(self.starts)))
        by = sorted_places(t.one)
        new = firsts(t.one[by])
        self.word_by, self.word_starts = by, np.flatnonzero(new)
        self.words = t.one[by[self.word_starts]]
        self.word = np.empty(len(by), np.int64)
        self.word[by] = np.cumsum(new) - 1


def sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(starts) else np.zeros(0, x.dtype)


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the least bytes."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def flat(arrays: list[np.ndarray]) -> bytes:
    """Unsigned arrays in one buffer, after their item sizes and lengths."""
    head = np.array([len(arrays), *(y for x in arrays for y in (x.itemsize, len(x)))], np.uint32)
    return b"".join([head.tobytes(), *(x.tobytes() for x in arrays)])


def mapped(buffer: bytes | pa.Buffer) -> list[np.ndarray]:
    """Views of the arrays of a flat buffer (bytes, Arrow memory or a mapped file); nothing is copied."""
    head = np.frombuffer(buffer, np.uint32, 1)[0]
    shape = np.frombuffer(buffer, np.uint32, 2 * int(head), 4).tolist()
    at, out = 4 + 8 * int(head), []
    for size, n in zip(shape[::2], shape[1::2], strict=True):
        out.append(np.frombuffer(buffer, f"u{size}", n, at))
        at += size * n
    return out


class EliasFano:
    """A monotone sequence: low bits in words, high bits as unary gaps."""

    def __init__(self, low: np.ndarray, high: np.ndarray, head: np.ndarray):
        self.low, self.high, (self.n, self.bits) = low, high, head.tolist()

    @staticmethod
    def pack(values: np.ndarray) -> list[np.ndarray]:
        v = values.astype(_U, copy=False)
        n = len(v)
        bits = max(0, ((int(v[-1]) + 1) // n).bit_length() - 1) if n else 0
        low = np.zeros(n * bits // 64 + 2 if bits else 0, _U)
        if bits and n:
            part, at = v & _U((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(_U)
            first = np.flatnonzero(firsts(word))
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero(shift > _U(64 - bits))
            low[word[over] + 1] |= part[over] >> (_U(64) - shift[over])
        place = (v >> _U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(place[-1]) // 64 + 1 if n else 0, _U)
        if n:
            word = place >> 6
            first = np.flatnonzero(firsts(word))
            high[word[first]] = np.bitwise_or.reduceat(_U(1) << (place & 63).astype(_U), first)
        return [low, high, np.array([n, bits], _U)]

    def values(self) -> np.ndarray:
        """The sequence, from its first to its last value."""
        ones = np.flatnonzero(np.unpackbits(self.high.astype("<u8").view(np.uint8), bitorder="little"))
        out = (ones - np.arange(self.n)).astype(_U) << _U(self.bits)
        if self.bits and self.n:
            at = np.arange(self.n, dtype=np.int64) * self.bits
            word, shift = at >> 6, (at & 63).astype(_U)
            part = self.low[word] >> shift
            over = np.flatnonzero(shift > _U(64 - self.bits))
            part[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
            out |= part & _U((1 << self.bits) - 1)
        return out


def code(p: np.ndarray) -> np.ndarray:
    """log10 of probabilities in 16 bits."""
    return np.minimum(np.rint(-STEPS * np.log10(p)), ABSENT - 1).astype(np.uint16)


class Trie:
    """A shard's contexts, pointers, successors and codes, over one flat buffer."""

    def __init__(self, buffer: bytes | pa.Buffer):
        x = mapped(buffer)
        contexts, pointers, successors = (EliasFano(*x[k : k + 3]).values() for k in (0, 3, 6))
        self.contexts, self.pointers, self.successors = contexts, pointers.astype(np.int64), successors
        self.beta, self.alpha = x[9], x[10]

    @staticmethod
    def pack(contexts: np.ndarray, follow: np.ndarray, count: np.ndarray) -> bytes:
        """From contexts and successors in any order, with counts; those that are never there have no node."""
        seen = count > 0
        contexts, follow, count = contexts[seen], follow[seen], count[seen]
        by = sorted_places(contexts)
        rank = np.cumsum(firsts(contexts[by])) - 1
        full = rank.astype(_U) << _U(NEXT) | follow[by].astype(_U)
        again = sorted_places(full)
        full, count = full[again], count[by][again]
        starts = np.flatnonzero(firsts(full))
        full, count = full[starts], sums(count, starts)
        head = np.flatnonzero(firsts(full >> _U(NEXT)))
        total = sums(count, head)
        per_gram = np.repeat(total, np.diff(np.append(head, len(full))))
        keys = contexts[by][np.flatnonzero(firsts(rank))] if len(rank) else contexts
        return flat([*EliasFano.pack(keys), *EliasFano.pack(np.append(head, len(full))), *EliasFano.pack(full), code(M3 / (total + M3)), code(count / (per_gram + M3))])

    def find(self, contexts: np.ndarray, sizes: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of beta for contexts (0 for one that isn't there), and of alpha for the successors, `sizes` of each context."""
        at = np.searchsorted(self.contexts, contexts)
        at[at == len(self.contexts)] = 0
        there = self.contexts[at] == contexts if len(self.contexts) else np.zeros(len(contexts), bool)
        beta = np.zeros(len(contexts), np.uint16)
        beta[there] = self.beta[at[there]]
        alpha = np.full(len(follow), ABSENT, np.uint16)
        rank = np.repeat(np.where(there, at, -1), sizes)
        ask = np.flatnonzero(rank >= 0)
        rank = rank[ask]
        want = rank.astype(_U) << _U(NEXT) | follow[ask].astype(_U)
        place = np.searchsorted(self.successors, want)
        hit = place < self.pointers[rank + 1]
        hit[hit] = self.successors[place[hit]] == want[hit]
        alpha[ask[hit]] = self.alpha[place[hit]]
        return beta, alpha


def _bytes_of(x: np.ndarray) -> list[np.ndarray]:
    """16-bit numbers as two arrays of bytes, which compress better."""
    return [(x >> 8).astype(np.uint8), (x & 0xFF).astype(np.uint8)]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of runs of a partition's rows, the same whatever the batches."""
    held: list[pa.RecordBatch] = []
    size = rows = number = 0

    def out() -> tuple[int, pa.Table]:
        part = held[0].column("part")[0].as_py()
        return part << 33 | number, pa.Table.from_batches(held)

    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(b.column("text").cast(pa.binary())).to_numpy(zero_copy_only=False))
        i, done = 0, 0
        while i < b.num_rows:
            # a chunk ends with the row that fills it
            j = min(int(np.searchsorted(ends, done + CHUNK_BYTES - size)) + 1, i + CHUNK_ROWS - rows, b.num_rows)
            held.append(b.slice(i, j - i))
            size, rows, done, i = size + int(ends[j - 1]) - done, rows + j - i, int(ends[j - 1]), j
            if size >= CHUNK_BYTES or rows == CHUNK_ROWS:
                yield out()
                held, size, rows, number = [], 0, 0, number + 1
    if held:
        yield out()


def joined(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, and the offset of each and the end."""
    x = texts.cast(pa.large_binary()).combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    offsets = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _cut(keys: np.ndarray, shift: int, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of sorted keys by what is above `shift` bits."""
    of = (keys >> _U(shift)).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
    begin = np.flatnonzero(firsts(of))
    return zip(of[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True)


def split_contexts(docs: DataFrame, rows: int) -> np.ndarray:
    """Contexts with a share of 1/SPLIT of a sample's bigrams: SPLIT at most, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.sort(Tokens(*joined(pa.chunked_array([b.column("text")]))).context)
            starts = np.flatnonzero(firsts(x))
            n = np.diff(np.append(starts, len(x)))
            much = n * 2 * SPLIT >= len(x)
            yield pa.record_batch([pa.array(np.append(x[starts[much]].view(np.int64), 0)), pa.array(np.append(n[much], len(x))), pa.array([False] * int(much.sum()) + [True])], names=["x", "n", "all"])

    sample = docs.select("text").sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), 1).mapInArrow(run, "x long, n long, all boolean")
    found = sample.groupBy("all", "x").agg(F.sum("n").alias("n"))
    total = found.filter("all").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return np.sort(np.array([r["x"] for r in found.filter((~F.col("all")) & (F.col("n") * SPLIT >= total)).collect()], np.int64).view(_U))


def _answers(docs: DataFrame, bits: int, shard_bits: int, split: np.ndarray) -> DataFrame:
    """kind (0: words, 1: trigrams, 2: a shard's totals), shard, chunk, x: the answers; tokens and distinct, of totals alone."""
    shards = 1 << shard_bits

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in chunks(batches):
            tokens = Tokens(*joined(t.column("text")))
            a = Asked(tokens, bits, split)
            learn = np.repeat(t.column("train").to_numpy(), tokens.lengths).astype(np.int64)
            count, word_count = sums(learn[a.places], a.starts), sums(learn[a.word_by], a.word_starts)
            grams = np.concatenate(([0], np.cumsum(a.sizes)))
            kind, shard, x = [], [], []
            for s, i, j in _cut(a.contexts, bits - shard_bits, shards):
                g = slice(grams[i], grams[j])
                three = a.follow[g].astype("<u4").view(np.uint8).reshape(-1, 4)[:, : NEXT // 8].ravel()
                x.append(flat([*EliasFano.pack(a.contexts[i:j] & _U((1 << REST) - 1)), small(a.sizes[i:j]), three, small(count[g])]))
                kind.append(1)
                shard.append(s)
            for s, i, j in _cut(a.words, 64 - shard_bits, shards):
                x.append(flat([*EliasFano.pack(a.words[i:j] & _U((1 << 64 - shard_bits) - 1)), small(word_count[i:j])]))
                kind.append(0)
                shard.append(s)
            yield pa.record_batch([pa.array(kind, pa.int8()), pa.array(shard, pa.int64()), pa.array(np.full(len(x), number)), pa.array(x, pa.binary())], names=["kind", "shard", "chunk", "x"])

    def answer(t: pa.Table) -> pa.Table:
        kind, chunk, blocks = t.column("kind").to_numpy(), t.column("chunk").to_numpy(), [x for c in t.column("x").chunks for x in c]
        blocks = [mapped(x.as_buffer()) for x in blocks]
        of, out = [], []
        grams = []
        for k in np.flatnonzero(kind == 1):
            b = blocks[k]
            follow = np.zeros((len(b[4]) * 8 // NEXT, 4), np.uint8)
            follow[:, : NEXT // 8] = b[4].reshape(-1, NEXT // 8)
            grams.append((k, EliasFano(*b[:3]).values(), b[3].astype(np.int64), follow.view("<u4").ravel(), b[5].astype(np.int64)))
        if grams:
            trie = Trie(Trie.pack(np.concatenate([np.repeat(c, n) for _, c, n, _, _ in grams]), np.concatenate([g[3] for g in grams]), np.concatenate([g[4] for g in grams])))
            for k, contexts, sizes, follow, _ in grams:
                beta, alpha = trie.find(contexts, sizes, follow)
                of.append(k)
                out.append(flat([*_bytes_of(beta), *_bytes_of(alpha)]))
        words = [(k, EliasFano(*blocks[k][:3]).values(), blocks[k][3].astype(np.int64)) for k in np.flatnonzero(kind == 0)]
        known, total = np.zeros(0, _U), np.zeros(0, np.int64)
        if words:
            all_words, counts = np.concatenate([w for _, w, _ in words]), np.concatenate([c for _, _, c in words])
            by = np.argsort(all_words, kind="stable")
            starts = np.flatnonzero(firsts(all_words[by]))
            known, total = all_words[by[starts]], sums(counts[by], starts)
            for k, w, _ in words:
                of.append(k)
                out.append(flat([small(total[np.searchsorted(known, w)])]))
        own = t.column("shard")[0].as_py()
        n = len(of)
        return pa.table({"kind": pa.array([*kind[of].tolist(), 2], pa.int8()), "shard": pa.array([own] * (n + 1), pa.int64()), "chunk": pa.array([*chunk[of].tolist(), -1], pa.int64()), "x": pa.array([*out, b""], pa.binary()), "tokens": pa.array([None] * n + [int(total.sum())], pa.int64()), "distinct": pa.array([None] * n + [int((total > 0).sum())], pa.int64())})

    asked = docs.select("part", "text", "train").mapInArrow(ask, "kind byte, shard long, chunk long, x binary")
    return asked.repartition(shards, "shard").groupBy("shard").applyInArrow(answer, "kind byte, shard long, chunk long, x binary, tokens long, distinct long")


def score(docs: DataFrame, train: Column, *keep: Column) -> DataFrame:
    """doc_id, the columns of `keep`, n_tokens, n_known, train_tokens, base_score, score of every row, learnt from those in `train`."""
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(F.spark_partition_id().alias("part"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.struct(F.col("doc_id"), *keep).alias("own"))
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    shard_bits = (size >> SHARD).bit_length()
    bits, split = REST + shard_bits, split_contexts(docs, rows)
    answers = common.materialize(_answers(docs, bits, shard_bits, split), "answers")
    total, distinct = answers.filter("kind = 2").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    norm = max(total + ADD * (distinct + 1), ADD)
    own_type = docs.schema["own"].dataType

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in chunks(batches):
            data, offsets = joined(t.column("text"))
            own = t.column("own").combine_chunks()
            own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
            yield pa.record_batch([pa.array([number]), pa.array([len(data)]), pa.array([pa.Codec("zstd", 1).compress(data.tobytes(), asbytes=True)], pa.binary()), pa.array([offsets.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], names=["chunk", "size", "texts", "offsets", "own"])

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        row = texts.slice(0, 1)
        data = pa.Codec("zstd").decompress(row.column("texts")[0].as_buffer(), row.column("size")[0].as_py(), asbytes=True)
        t = Tokens(np.frombuffer(data, np.uint8), np.frombuffer(row.column("offsets")[0].as_py(), np.int64))
        a = Asked(t, bits, split)
        found = found.sort_by([("kind", "ascending"), ("shard", "ascending")])
        blocks = [mapped(x.as_buffer()) for c in found.column("x").chunks for x in c]
        kind = found.column("kind").to_numpy()
        known = np.concatenate([b[0].astype(np.int64) for b, k in zip(blocks, kind, strict=True) if k == 0])
        n = len(t.one)
        count = known[a.word].astype(np.float64)
        p1 = (count + ADD) / norm
        p = p1.copy()
        if len(t.at):
            codes = [np.concatenate([b[i] for b, k in zip(blocks, kind, strict=True) if k == 1]).astype(np.uint16) for i in range(4)]
            beta_code, alpha_code = codes[0] << 8 | codes[1], codes[2] << 8 | codes[3]
            beta_of = 10.0 ** (-np.arange(ABSENT + 1) / STEPS)
            alpha_of = beta_of.copy()
            alpha_of[ABSENT] = 0
            m = len(t.at)
            alpha, beta = np.zeros(n), np.ones(n)
            alpha[t.at], beta[t.at] = alpha_of[alpha_code[a.gram[:m]]], beta_of[beta_code[a.of[:m]]]
            if len(a.split):
                # the context's own entry has beta; its trigram, a context too, has the count in its beta
                at = t.at[a.split]
                c3 = M3 / beta[at] - M3
                beta[at] = beta_of[beta_code[a.of[m:]]]
                alpha[at] = c3 * beta[at] / M3
            c2 = M3 / beta[t.at] - M3
            p[t.at] = (c2 + M2 * p1[t.at]) / (count[t.at - 1] + M2)
            third = np.ones(n, bool)
            third[t.begin] = False
            third[np.minimum(t.begin + 1, n - 1)] = False
            third = np.flatnonzero(third)
            p[third] = alpha[third - 1] + beta[third - 1] * p[third]
        sums_ = [np.add.reduceat(x, t.begin) for x in ((count > 0).astype(np.int64), np.log10(p1), np.log10(p))]
        own = row.column("own").combine_chunks()
        own = (own.chunk(0) if isinstance(own, pa.ChunkedArray) else own).flatten()
        return pa.table({"own": own, "n_tokens": t.lengths, "n_known": sums_[0], "base_score": sums_[1], "score": np.minimum(sums_[2], 0.0)})

    texts = docs.select("part", "text", "own").mapInArrow(packed, T.StructType([T.StructField("chunk", T.LongType()), T.StructField("size", T.LongType()), T.StructField("texts", T.BinaryType()), T.StructField("offsets", T.BinaryType()), T.StructField("own", T.ArrayType(own_type))]))
    schema = T.StructType([T.StructField("own", own_type), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    out = texts.groupBy("chunk").cogroup(answers.filter("kind < 2").select("kind", "shard", "chunk", "x").groupBy("chunk")).applyInArrow(run, schema)
    return out.select(*(F.col("own")[f.name].alias(f.name) for f in own_type.fields), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, common.fold("doc_id", 10) != 0, F.coalesce(common.fold("doc_id", 10) == 0, F.lit(False)).alias("held_out"))
