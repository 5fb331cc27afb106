"""Near-duplicates by b-bit MinHash, confirmed on full sets.

A document's set holds its distinct shingles of `width` words. HASHES minima make BANDS bands of ROWS minima for
candidates, and BITS low bits of each (mixed) minimum a packed signature. The share of equal fields, corrected for
chance, estimates the similarity of candidates by bit counts; what is far below the threshold goes, all else is
confirmed on full sets. A pair at 0.8 escapes the bands with odds of 5e-8 and the estimate with odds of 1e-6.

Steps, none with all pairs of a group of copies:
1. Documents with equal sets form a class; from here on one document stands for its class.
2. Each bucket of a band links its members to its smallest one where the estimate allows it. Buckets whose members
   are not all connected yet are compared within blocks on signatures alone, and give a spanning forest of links.
3. Components of these estimated links hold every true link. Their members' texts go, in blocks of bounded bytes, to
   tasks that confirm links on full sets: only pairs not connected yet are looked at, likeliest first. In a group of
   many blocks each one first meets one common block, which is linear in the group; only members that this leaves
   outside the group's largest component then meet its other blocks.
4. Components of confirmed links give component_id, for all documents of the classes.

Texts without words, and nulls, have an empty set, no link, and their own component. A row with a null doc_id is its
own component with a null id, and is kept. Rows with one doc_id are one document: what links with one of them is in
the component of all. Only keep_one() tells them apart, and keeps different texts with one doc_id like other documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.llm import common

HASHES, BANDS, ROWS, BITS = 128, 32, 4, 4
#: Estimated similarity, in hundredths, that candidates must reach at a threshold of 80: five standard errors less.
SLACK = 20
#: Members of a block of signatures, and members and bytes of sets in a block of texts, that one comparison holds.
BLOCK, BLOCK_MEMBERS, BLOCK_SET_BYTES = 1024, 4096, 8 << 20
REMEMBERED = 300_000
_rng = np.random.default_rng(20250101)
_A = (_rng.integers(0, 1 << 31, HASHES, np.uint32) * 2 + 1)[:, None].astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint32)[:, None].astype(np.uint32)
_NIBBLES = np.uint64(0x1111111111111111)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingles:
    def __init__(self, width: int):
        self.width, self.of = width, _Hashes().__getitem__

    def set(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles; the whole sequence is one where words are fewer."""
        w = common.words(text)
        if not w:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.of, w), np.uint64, len(w))
        k = min(self.width, len(w))
        x = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(x)


def minima(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a set that isn't empty, in steps that stay in cache."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    m = (_A * h[None, :1024] + _B).min(1)
    for i in range(1024, len(h), 1024):
        np.minimum(m, (_A * h[None, i : i + 1024] + _B).min(1), out=m)
    return m


def signature(m: np.ndarray) -> np.ndarray:
    """BITS low bits of each mixed minimum, packed into longs of 16 fields."""
    low = (((m * np.uint32(0x9E3779B1)) ^ (m >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(28)).astype(np.uint64)
    return np.bitwise_or.reduce(low.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(BITS)), 1)


def bands(m: np.ndarray) -> np.ndarray:
    g = m.reshape(BANDS, ROWS).astype(np.uint64)
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + g[:, i])
    return x.view(np.int64)


def estimate(matches: np.ndarray | Column) -> np.ndarray | Column:
    """Similarity from the number of equal fields: chance makes one in 2**BITS of the others equal."""
    c = 1 / (1 << BITS)
    return (matches / HASHES - c) / (1 - c)


def equal_fields(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts of equal fields between signatures a (m, 8) and b (n, 8)."""
    differ = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        differ += np.bitwise_count(x & _NIBBLES)
    return HASHES - differ.astype(np.int32)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sig and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingles(width)
        for b in batches:
            n, digest, sig, band = [], [], [], []
            for text in common.raw(b.column("text")):
                s = sh.set(text)
                n.append(len(s))
                digest.append(xxhash.xxh128_digest(s.tobytes()))
                m = minima(s) if len(s) else None
                sig.append(signature(m).view(np.int64) if len(s) else None)
                band.append(bands(m) if len(s) else None)
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig array<long>, bands array<long>")


def _matches(a: str, b: str) -> Column:
    """equal_fields() of two signature columns."""

    def count(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(HASHES) - sum((count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(HASHES * BITS // 64)), F.lit(0))


def _blocked(df: DataFrame, blocks: Column, key: str) -> DataFrame:
    """Each row once per pair of blocks (i <= j) that holds it; a group of one block is its own pair."""
    own = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    df = df.withColumn("nb", blocks.cast("int")).withColumn("own", own)
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return df.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "nb")


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """A forest of estimated links between members of blocks that aren't connected yet."""
    for t in common.groups(batches, ["key", "i", "j"]):
        own, rep = t["own"].to_numpy(), t["rep"].to_numpy()
        sig = np.array(t["sig"].to_pylist(), np.int64).view(np.uint64)
        _, comp = np.unique(t["comp"].to_numpy(), return_inverse=True)
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        forest, links = Forest(comp.max() + 1), []
        left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j))
        for s in range(0, len(left), 64):
            rows = left[s : s + 64]
            roots = np.array([forest.find(c) for c in range(len(forest.up))])[comp]
            ok = (estimate(equal_fields(sig[rows], sig[right])) >= least) & (roots[rows][:, None] != roots[right][None, :])
            for a, b in zip(*np.nonzero(ok), strict=True):
                if forest.join(comp[rows[a]], comp[right[b]]):
                    links.append((rep[rows[a]], rep[right[b]]))
        if links:
            a, b = np.array(links).T
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int, least: float, width: int) -> Iterator[pa.RecordBatch]:
    """A forest of confirmed links between the left and right rows of blocks that aren't connected yet."""
    sh = Shingles(width)
    for t in common.groups(batches, ["comp", "i", "j"]):
        made = [sh.set(x) for x in common.raw(t["text"].combine_chunks())]
        own = np.array([xxhash.xxh128_digest(s.tobytes()) == d for s, d in zip(made, t["digest"].to_pylist(), strict=True)])  # of a repeated id only the right row
        t, sets = t.filter(pa.array(own)), [s for s, ok in zip(made, own, strict=True) if ok]
        rep, left, right = (t[c].to_numpy() for c in ("rep", "is_left", "is_right"))
        sig = np.array(t["sig"].to_pylist(), np.int64).reshape(len(rep), -1).view(np.uint64)
        size = np.array([len(s) for s in sets])
        _, root = np.unique(t["part"].to_numpy(), return_inverse=True)
        links = []
        rights = np.flatnonzero(right)
        off = np.concatenate(([0], np.cumsum(size)))
        values, ids = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True)
        inside = np.zeros(len(values), np.uint8)
        for x in np.flatnonzero(left):
            m, n, o = equal_fields(sig[x : x + 1], sig[rights])[0], size[x], size[rights]
            ok = (estimate(m) >= least) & (100 * np.minimum(n, o) >= percent * np.maximum(n, o)) & (root[rights] != root[x])
            todo = rights[ok][np.argsort(-m[ok], kind="stable")]
            if not len(todo):
                continue
            inside[ids[off[x] : off[x + 1]]] = 1
            step = 1
            while len(todo):
                some, todo = todo[:step], todo[step:]
                long = size[some]
                begin = np.cumsum(long) - long
                both = np.add.reduceat(inside[ids[np.repeat(off[some] - begin, long) + np.arange(long.sum())]], begin, dtype=np.int64)
                for y in some[100 * both >= percent * (n + long - both)]:
                    if root[y] != root[x]:
                        root[root == root[y]] = root[x]
                        links.append((rep[x], rep[y]))
                todo = todo[root[todo] != root[x]]
                step = min(4 * step, 256)
            inside[ids[off[x] : off[x + 1]]] = 0
        if links:
            a, b = np.array(links).T
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) from links (a, b): large-star and small-star steps until nothing moves.

    A hub's links are dealt to many tasks by their other end.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:  # larger neighbours of a node go to its smallest neighbour or itself
        e = common.with_totals(both(e), "a", "b", F.least(F.min("b"), F.first("a")).alias("m"), rows="b > a")
        return e.select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:  # a node and its smaller neighbours go to the smallest of them
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        e = common.with_totals(e, "a", "b", F.min("b").alias("m"))
        return e.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()

    state = None
    e = common.materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        new = common.materialize(small(large(e)), "links")
        common.discard(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select("b", "b").distinct())


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    least = (percent - SLACK) / 100
    sigs = common.materialize(signatures(docs, width), "signatures")
    linked = sigs.filter("n_shingles > 0 and doc_id is not null")
    classes = common.materialize(linked.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("x")).select("digest", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), "x.sig", "x.bands"), "classes")
    # 2: buckets of more than one class
    keys = classes.select(F.explode("bands").alias("key"), "rep")
    buckets = common.materialize(common.with_totals(keys, "key", "rep", F.count("*").alias("members"), F.min("rep").alias("centre"), where="members > 1"), "buckets")
    of = classes.select("rep", "sig")
    star = common.materialize(buckets.filter("rep <> centre").select("rep", "centre").distinct().join(of, "rep"), "pairs")
    star = common.join_hot(star, of.select(F.col("rep").alias("centre"), F.col("sig").alias("sig2")), "centre", "rep")
    stars = common.materialize(star.filter(estimate(_matches("sig", "sig2")) >= least).select(F.col("rep").alias("a"), F.col("centre").alias("b")), "stars")
    label = components(stars)
    member = buckets.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).select("key", "rep", "members", "comp")
    # buckets with the same members are one; those of two are settled by their star
    open_ = member.filter("members > 2").groupBy("key", "members").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep", F.lit(7)).cast("decimal(38,0)")).alias("s")).filter("lo < hi")
    open_ = open_.groupBy("members", "x", "s").agg(F.min("key").alias("key")).select("key")
    todo = common.join_hot(member, open_, "key", "rep").join(of, "rep")
    todo = _blocked(todo, F.ceil(F.col("members") / BLOCK), "key").select("key", "i", "j", "own", "rep", "comp", "sig")
    more = todo.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").mapInArrow(lambda x: _similar(x, least), "a long, b long")
    label = common.materialize(components(stars.unionAll(more)), "estimated").withColumnRenamed("node", "rep").withColumnRenamed("component", "comp")
    # 3: their members, in blocks
    blocks = F.ceil(F.greatest(F.sum("n") * 8 / BLOCK_SET_BYTES, F.count("*") / BLOCK_MEMBERS)).cast("int")
    member = label.join(classes.select("rep", "digest", "sig", "n"), "rep")
    member = common.with_totals(member, "comp", "rep", blocks.alias("nb")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    member = common.materialize(member, "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")

    def confirmed(rows: DataFrame) -> DataFrame:
        """Links within the blocks (comp, i, j) of rows, whose texts are fetched here."""
        rows = texts.join(rows.select("rep", "part", "digest", "sig", F.explode("blocks").alias("b"), "comp"), "rep").select("comp", "b.i", "b.j", "b.is_left", "b.is_right", "rep", "part", "digest", "sig", "text")
        return rows.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "rep").mapInArrow(lambda x: _confirm(x, percent, least, width), "a long, b long")

    def block(i: Column, j: Column, is_left: Column, is_right: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), is_left.alias("is_left"), is_right.alias("is_right"))

    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    common_block = F.transform(F.sequence(zero, F.col("nb") - 1), lambda i: block(i, zero, i == 0, yes))
    first = member.withColumn("part", F.col("rep")).withColumn("blocks", F.when(F.col("own") == 0, common_block).otherwise(F.array(block(F.col("own"), zero, yes, yes))))
    links = common.materialize(confirmed(first), "confirmed")
    many = member.filter("nb > 1")
    if not many.isEmpty():
        done = components(links).withColumnRenamed("node", "rep").withColumnRenamed("component", "part")
        many = many.join(done, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
        parts = many.groupBy("comp", "part").agg(F.sum("n").alias("bytes"), F.count("*").alias("count"))
        largest = parts.groupBy("comp").agg(F.max_by("part", F.struct("count", "part")).alias("largest"), F.sum("bytes").alias("bytes"), F.sum("count").alias("count"), F.max(F.struct("count", "part", "bytes")).alias("x"))
        left_bytes, left_count = F.col("bytes") - F.col("x.bytes"), F.col("count") - F.col("x.count")
        rest = largest.filter(left_count > 0).select("comp", "largest", F.ceil(F.greatest(left_bytes * 8 / BLOCK_SET_BYTES, left_count / BLOCK_MEMBERS)).cast("int").alias("ns"))
        many = common.join_hot(many, rest, "comp", "rep")
        outside = F.transform(F.sequence(zero, F.col("nb") - 1), lambda j: block(F.pmod(F.xxhash64("rep"), F.col("ns")), j, yes, no))
        every = F.transform(F.sequence(zero, F.col("ns") - 1), lambda i: block(i, F.col("own"), no, yes))
        second = many.withColumn("blocks", F.when(F.col("part") != F.col("largest"), F.concat(every, outside)).otherwise(every))
        links = links.unionAll(confirmed(second))
    # 4: back to documents; a document with several sets links their classes
    several = linked.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("doc_id")
    own = linked.join(several, "doc_id").select("doc_id", "digest").distinct().join(classes.select("digest", "rep"), "digest")
    done = components(links.unionAll(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    named = classes.select("digest", "rep").join(done.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    alone = sigs.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return common.join_hot(linked.select("doc_id", "n_shingles", "digest"), named, "digest", "doc_id").select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionAll(alone)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, with all its columns: the smallest doc_id; rows without doc_id all stay.

    Rows that share a doc_id are taken by their texts: they come before all others, and equal ones leave one.
    """
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    key = next(x for k in range(len(docs.columns) + 1) if (x := f"key_{k}") not in {c.lower() for c in docs.columns})
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if repeated.isEmpty():
        keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    else:
        twice = docs.join(repeated, "doc_id", "left_semi").select(*columns)
        once = docs.join(repeated, "doc_id", "left_anti").select(*columns)
        keyed = once.withColumn(key, F.col("doc_id").cast("long")).unionAll(twice.withColumn(key, -F.abs(F.xxhash64("doc_id", F.coalesce("text", F.lit("")))) - 1).dropDuplicates([key]))
        keyed = common.materialize(keyed, "keyed")
    kept = near_components(keyed.select(F.col(key).alias("doc_id"), "text"), width, percent).filter("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    same = keyed.filter(F.col(key).isNotNull()).join(kept, key, "left_semi").select(*columns)
    return same.unionAll(keyed.filter(F.col(key).isNull()).select(*columns))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(common.table(spark, sf_dir, "documents"), width=4, percent=80)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
