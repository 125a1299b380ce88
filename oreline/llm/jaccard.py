"""Pairs of texts whose shingle sets are similar (Jaccard): candidates by prefixes, checked on whole texts.

Any order of all shingles will do: two sets of similarity t or more share one of the first
n - ceil(t * n) + 1 shingles of each, n its size; where they share one also tells how many they can
share at most. Shingles that are frequent in a sample come last, so that passages which many texts
hold bring few of them together. The sample decides cost, not results.

Before texts are fetched, pairs are held against parity bitmaps: every shingle turns one bit, so two
bitmaps differ in no more bits than the sets differ in shingles. That drops no pair that is similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.llm.common import cut

#: Of the texts one in so many has its shingles counted for the order; so many shingles are known as frequent at most.
COUNTED, FREQUENT = 16, 200_000
#: Nodes up to which the list of texts to fetch is broadcast.
SMALL = 200_000


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The different shingles of ``width`` words of a whole text, as sorted hashes of 64 bits.

    Words are those of ``simhash.fingerprint``; fewer words make one shingle, none make an empty one.
    """
    words = (text or "").encode().lower().split()
    known = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(max(1, len(words) - width + 1), n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[k : k + len(out)]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(out ^ (out >> np.uint64(29)))


def node_of(shingles: np.ndarray) -> int:
    """What texts of the same shingles share, as a signed long (n sets share some with chance n * n / 2**65)."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def parity(shingles: np.ndarray) -> bytes:
    """A bitmap of about two bits a shingle (64 to 65536, a power of two) in which each shingle turns one."""
    n = 1 << min(max(6, int(2 * len(shingles) - 1).bit_length()), 16)
    ones = np.bincount((shingles & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many shingles the sets of two bitmaps differ at least; the larger bitmap is folded to the smaller."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets have a Jaccard similarity of ``similarity`` or more."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if len(small) < similarity * len(large) - 1e-9:
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of the sample have, sorted, and how many have them."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), width).view(np.int64))], names=["token"])

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).select("text").mapInArrow(some, "token long")
    rows = sample.groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(FREQUENT).toPandas()
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], rows["count"].to_numpy(np.int64)[order]


def prefixes(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``token``, ``node``, ``size``, ``place``: the shingles in the prefix of each of ``texts`` (text), with their
    place there, that another node has in its own."""
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, times = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found, nodes, sizes = [], [], []
                for t in batch.column(0).slice(at, 256):
                    s = shingle_set(t.as_py(), width)
                    nodes.append(node_of(s))
                    sizes.append(len(s))
                    if len(token):
                        near = np.minimum(np.searchsorted(token, s), len(token) - 1)
                        s = s[np.argsort(np.where(token[near] == s, times[near], 0), kind="stable")]
                    found.append(s[: len(s) - ceil(similarity * len(s) - 1e-9) + 1])
                long = [len(x) for x in found]
                places = np.concatenate([np.arange(n, dtype=np.int32) for n in long])
                columns = np.concatenate(found).view(np.int64), np.repeat(np.array(nodes, np.int64), long), np.repeat(np.array(sizes, np.int32), long), places
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "node", "size", "place"])

    rows = texts.select("text").mapInArrow(run, "token long, node long, size int, place int")
    each = Window.partitionBy("token")
    return rows.select("*", F.min("node").over(each).alias("least"), F.max("node").over(each).alias("most")).where("least != most").select("token", "node", "size", "place").distinct()


def candidates(shared: DataFrame, clusters: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: pairs that share a token of ``shared`` (``prefixes``) at places that leave enough others to share,
    and are not connected by ``clusters`` (member, root) yet. A group that is connected already costs no pairs."""
    rows = shared.join(clusters, F.col("node") == F.col("member"), "left").select("token", "node", "size", "place", F.coalesce("root", "node").alias("root"))
    each = Window.partitionBy("token")
    rows = rows.select("*", F.min("root").over(each).alias("least"), F.max("root").over(each).alias("most")).where("least != most").drop("least", "most")
    rows = cut(rows, "mixed")
    a, b = rows.toDF("token", "a", "size_a", "place_a", "root_a"), rows.toDF("token", "b", "size_b", "place_b", "root_b")
    both = (F.col("size_a") + F.col("size_b")) * (similarity / (1 + similarity)) - 1e-6  # that the pair must share
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    # The first shared token of a pair has all others behind it in both; at later ones the pair may fail here.
    fits = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9) & (left >= both)
    return a.join(b, "token").where(fits).select("a", "b").distinct()


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) whose bitmaps do not rule the similarity out. nodes: node, ``size`` of the set, ``bits``."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    side = nodes.select("node", "size", "bits")
    both = pairs.join(side.toDF("a", "size_a", "bits_a"), "a").join(side.toDF("b", "size_b", "bits_b"), "b").select("a", "b", "size_a", "size_b", "bits_a", "bits_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (1 - similarity) / (1 + similarity) * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) + 1e-6
            keep = [apart(x, y) <= m for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose texts have the similarity. nodes: node, ``size``, ``bits`` and the
    ``text_key`` of one of its texts; texts: ``text_key``, ``text``."""
    pairs = cut(plausible(pairs, nodes, similarity), "pairs")
    need = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "text_key"), "node"), "needed")
    n = need.count()
    if not n:
        return pairs
    found = texts.join(F.broadcast(need) if n <= SMALL else need, "text_key").dropDuplicates(["node"]).select("node", "text")
    found = cut(found, "texts")
    both = pairs.join(found.toDF("a", "text_a"), "a").join(found.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, left = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != before:  # the join leaves rows of a text together
                    before, left = b, shingle_set(y.as_py(), width)
                keep.append(alike(shingle_set(x.as_py(), width), left, similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.mapInArrow(check, "a long, b long"), "similar")
