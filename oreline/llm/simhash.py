"""Near duplicates by SimHash, candidates by the general pigeonhole principle.

Pairs within ``radius`` differing bits are found exactly. The bits are grouped so that correlated
bits share a partition; thresholds T with sum(T) = radius - m + 1 guarantee that a pair within the
radius is within T[i] on some partition i (Qin et al., 2018). Partition number and thresholds come
from dynamic programming over estimated candidates and signatures.

Links may reach further than the radius: ``accept`` bits. Pairs between the two are linked wherever
some partition brings them together, which for wide prints with many partitions is nearly always.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, inf

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm import jaccard
from oreline.llm.common import cut, numbered, restored
from oreline.llm.graph import connected_components
from oreline.llm.jaccard import node_of, parity, shingle_set

BITS = 64
#: For documents of a similarity (Jaccard, shingles) of 0.8 or more: bits of a print, radius, bits at
#: which links end. A pair at 0.8 differs in 39 of 256 bits on average, one at 0.6 in 59: these links
#: are a cheap start, an exact join finds the rest.
WIDE_BITS, WIDE_RADIUS, WIDE_ACCEPT = 256, 19, 44
#: Jaccard similarity of the shingles from which ``deduplicate`` links.
SIMILARITY = 0.8
#: Rows of a bucket that one task compares at once; larger buckets are cut into pairs of blocks.
BLOCK = 2048
#: Keys of rows that go up to which they are broadcast; beyond, a join by shuffle takes them away.
SMALL = 1_000_000
#: Rows of one print from which, at least, the print goes to the rows.
HOT = 200
#: What a signature row and a compared pair cost, in microseconds.
ROW_US, PAIR_US = 3.0, 0.01
#: Odd factors that make further words of a wide print from a shingle's hash.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def fingerprint(text: str | None, width: int = 4, bits: int = BITS) -> np.ndarray:
    """The SimHash of a whole text over shingles of ``width`` words, repeats included, as words of 64 bits.

    A-Z fold to a-z, words end at ASCII white space, fewer words make one shingle, none make zero.
    The first word votes on the shingles' XXH64 (seed 42), further ones on mixes of it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(bits // 64, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(width, len(words)) - 1 :]
    first = np.concatenate(([0], ends[: len(last) - 1] + 1))
    ones = np.zeros(bits, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), 1 << 14):
        spans = zip(first[at : at + (1 << 14)].tolist(), last[at : at + (1 << 14)].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], 42) for i, j in spans], np.uint64)
        ones += _bits(_widened(hashes, bits)).sum(0, np.int64)
    return np.packbits(2 * ones > len(last), bitorder="little").view(np.uint64)


def _widened(hashes: np.ndarray, bits: int) -> np.ndarray:
    out = [hashes]
    for k in range(bits // 64 - 1):
        x = (hashes ^ (hashes >> np.uint64(29))) * _MIX[k]
        x = (x ^ (x >> np.uint64(32))) * _MIX[k - 1]
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, 1)


def fingerprint_column(text: Column, width: int = 4, bits: int = BITS) -> Column:
    """``fingerprint`` as a struct of ``fp`` (bytes) and ``node``: the print itself as a signed long, or
    the hash of a wider one (n prints share some with chance n * n / 2**65)."""

    @F.arrow_udf("struct<node:long,fp:binary>")
    def compute(texts: pa.Array) -> pa.Array:
        prints = [fingerprint(t.as_py(), width, bits) for t in texts]
        nodes = np.array([x[0] if bits == 64 else xxhash.xxh64_intdigest(x.tobytes()) for x in prints], np.uint64).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(nodes), pa.array([x.tobytes() for x in prints], pa.binary())], names=["node", "fp"])

    return compute(text)


# --- the plan: partitions of bits and thresholds -----------------------------------------------


def _words(prints: pa.Array) -> np.ndarray:
    """Prints of a column of bytes, a row of 64-bit words each."""
    return np.frombuffer(b"".join(prints.to_pylist()), np.uint64).reshape(len(prints), -1) if len(prints) else np.zeros((0, 1), np.uint64)


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")


def bit_counts(prints: DataFrame, bits: int) -> np.ndarray:
    """How often bits a and b are both set, as a matrix; the diagonal has single bits."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bits, bits))
        for batch in batches:
            found = _bits(_words(batch.column(0))).astype(np.float64) if batch.num_rows else np.zeros((0, bits))
            total += found.T @ found
        at = np.triu_indices(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total[at].astype(np.int64))], names=["a", "b", "n"])

    rows = prints.select("fp").mapInArrow(partial, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((bits, bits))
    a, b, n = (x.to_numpy() for x in rows.columns)  # one for each pair of bits
    out[a, b] = out[b, a] = n
    return out


def group_bits(counts: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` groups of bits of near equal width; each grows by the free bit most correlated with it."""
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    near = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    free, groups = np.ones(len(p), bool), []
    for k in range(m):
        group: list[int] = []
        pull = near[:, free].sum(1)
        for _ in range(len(p) // m + (k < len(p) % m)):
            best = int(np.argmax(np.where(free, pull, -1)))
            pull = near[:, best] + (pull if group else 0)
            group.append(best)
            free[best] = False
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, most: int) -> list[float]:
    """Chance that at most t of independent bits with these frequencies differ, for t in 0..most."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for q in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return np.maximum(np.cumsum(chance), 1e-300).tolist()


def allocate(groups: list[list[int]], p: np.ndarray, n: int, radius: int, pairs: list[float] | None = None) -> tuple[float, list[int]]:
    """Cheapest thresholds with sum radius - m + 1, and their cost. -1 leaves a partition out.

    pairs: how many pairs agree on the whole of each partition, where that is known; estimates for
    larger thresholds scale from it.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i, group in enumerate(groups):
        chance = within(p[group], radius)
        known = n * (n - 1) / 2 * chance[0] if pairs is None else pairs[i]
        cost = {-1: 0.0} | {t: PAIR_US * known * chance[t] / chance[0] + ROW_US * n * (t > 0) + ROW_US * n * sum(comb(len(group), k) for k in range(t + 1)) for t in range(radius + 1)}
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t, c in cost.items():
                if spent + c < step.get(total + t, (inf,))[0]:
                    step[total + t] = (spent + c, [*chosen, t])
        best = step
    return best[radius - len(groups) + 1]


SIGNATURES = "part int, key long, probe int, node long, fp binary"


def signatures(groups: list[list[int]], limits: list[int]):
    """For ``mapInArrow``: each print's bits of every partition with a threshold from 0, packed (probe 0), and
    where the threshold is above 0 all keys within it (probe 1)."""
    flips = [np.array([sum(1 << b for b in flip) for k in range(t + 1) for flip in combinations(range(len(g)), k)], np.int64) if t > 0 else None for g, t in zip(groups, limits, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                found = _bits(_words(some.column(1)))
                for i, group in enumerate(groups):
                    if limits[i] < 0:
                        continue
                    key = found[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))
                    for probe, each in ((0, None), (1, flips[i])):
                        if probe and each is None:
                            continue
                        row = np.arange(len(key)) if each is None else np.repeat(np.arange(len(key)), len(each))
                        keys = key if each is None else (key[:, None] ^ each[None, :]).ravel()
                        same = lambda x: pa.array(np.full(len(row), x, np.int32))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([same(i), pa.array(keys), same(probe), some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row))], names=["part", "key", "probe", "node", "fp"])

    return run


# --- probing and verifying -----------------------------------------------------------------------


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of prints, word by word."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for k in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def links(prints: np.ndarray, probe: np.ndarray, accept: int) -> Iterator[tuple[int, int]]:
    """Rows that span the graph that joins prints within ``accept`` differing bits: a component of k prints
    has k - 1. probe: which rows are probes; if any is, only pairs of a probe and another row count."""
    mixed = bool(probe.any())
    home = np.flatnonzero(~probe)
    other = np.flatnonzero(probe) if mixed else home
    linked = np.zeros(len(prints), bool)
    for at in range(0, len(home), 256):
        row = home[at : at + 256]
        near = _differ(prints[row][:, None], prints[other][None, :])
        near = (near <= accept) & (near > 0)
        linked[row] |= near.any(1)
        linked[other] |= near.any(0)
    left = np.flatnonzero(linked)
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            apart = _differ(prints[left], prints[x][None])
            hit = apart <= accept
            if mixed:
                hit &= probe[left] != probe[x]
            for y, d in zip(left[hit].tolist(), apart[hit].tolist(), strict=True):
                if d:
                    yield int(x), y
                todo.append(y)
            left = left[~hit]


def _bucket_links(accept: int):
    def bucket(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(parts)
        if rows.num_rows < 2:
            return None
        nodes = rows["node"].to_numpy()
        probe = rows["probe"].to_numpy() > 0
        edges = np.array(list(links(_words(rows["fp"].combine_chunks()), probe, accept)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(nodes[edges[:, 0]]), pa.array(nodes[edges[:, 1]])], names=["a", "b"]) if len(edges) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the bucket that the last batch ended in
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "key", "pair")])
            starts = [0, *(np.flatnonzero((now[:, 1:] != now[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if held and before != tuple(now[:, i]):
                    if (found := bucket(held)) is not None:
                        yield found
                    held = []
                before = tuple(now[:, i])
                held.append(batch.slice(i, j - i))
        if held and (found := bucket(held)) is not None:
            yield found

    return run


def near_links(prints: DataFrame, bits: int = BITS, radius: int = 4, accept: int | None = None) -> DataFrame:
    """Edges ``a``, ``b`` between nodes of ``prints`` (node, fp), which has each print once.

    They connect all that pairs within ``radius`` differing bits connect, and only pairs within
    ``accept`` (by default the radius). A bucket beyond ``BLOCK`` rows is cut into blocks by hash, and
    a task takes a pair of blocks.
    """
    spark = prints.sparkSession
    n = prints.count()
    if n < 2:  # nothing to link, and no counts to plan by
        return spark.createDataFrame([], "a long, b long")
    counts = bit_counts(prints, bits)
    p = np.diag(counts) / max(n, 1)
    groups = min((group_bits(counts, n, m) for m in range(2, radius + 3)), key=lambda g: allocate(g, p, n, radius)[0])
    home = prints.select("node", "fp").mapInArrow(signatures(groups, [0] * len(groups)), SIGNATURES)
    sizes = cut(home.groupBy("part", "key").count(), "buckets")
    same = {i: float(c) for i, c in sizes.groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).collect()}
    _, limits = allocate(groups, p, n, radius, [same.get(i, 0.0) for i in range(len(groups))])

    rows = prints.select("node", "fp").mapInArrow(signatures(groups, limits), SIGNATURES)
    if any(t > 0 for t in limits):
        sizes = rows.groupBy("part", "key").count()
    hot = cut(sizes.where(F.col("count") > BLOCK).select("part", "key", F.ceil(F.col("count") / BLOCK).alias("blocks")), "hot")
    if n_hot := hot.count():
        rows = rows.join(F.broadcast(hot) if n_hot < 100_000 else hot, ["part", "key"], "left")
        own = F.pmod(F.xxhash64("node"), F.col("blocks"))
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
        rows = rows.withColumn("pair", F.explode(F.coalesce(pair, F.array(F.lit(0).cast("long")))))
    else:
        rows = rows.withColumn("pair", F.lit(0).cast("long"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.select("part", "key", "pair", "node", "fp", "probe").repartition(parts, "part", "key", "pair").sortWithinPartitions("part", "key", "pair")
    return rows.mapInArrow(_bucket_links(radius if accept is None else accept), "a long, b long").distinct()


def _grouped(docs: DataFrame, id_: Column, text: Column, width: int, bits: int, radius: int, accept: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node), and of each node its component and the component's least row.

    The least row has the smallest id, null last, and of rows that share it the smallest hash of the text.
    """
    rows = docs.select(id_.alias("doc_id"), F.xxhash64(text).alias("text_key"), fingerprint_column(text, width, bits).alias("print"))
    rows = cut(rows.select("doc_id", "text_key", "print.*"), "prints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    prints = cut(rows.groupBy("node").agg(F.min(row).alias("least"), F.first("fp").alias("fp"), F.count("*").alias("n")), "distinct")
    found = connected_components(near_links(prints, bits, radius, accept), "a", "b").withColumnRenamed("node", "member")
    least = found.join(prints, found.member == prints.node).groupBy("root").agg(F.min("least").alias("least_all"))
    named = prints.select("node", "least", "n").join(found.join(least, "root"), F.col("node") == F.col("member"), "left")
    return rows.select("doc_id", "node"), named.select("node", "n", F.coalesce("root", "node").alias("component"), F.coalesce("least_all", "least").alias("least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = BITS, radius: int = 4, accept: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``node`` (the signed print, or the hash of a wide one),
    ``component_id`` (smallest id that links reach, itself included) and ``component`` (a node).

    Null and empty texts have print zero and link like any other. Rows with a null id take part;
    a component of only such rows has a null component_id. Repeated rows and ids give a row each.
    Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    rows, named = _grouped(docs, F.col(id_col), F.col(text_col), width, bits, radius, radius if accept is None else accept)
    named = cut(named, "named")
    # A print of many rows goes to the rows, and at most ``SMALL`` prints have so many; the rows of others meet theirs by a shuffle.
    many = max(HOT, (named.agg(F.sum("n")).first()[0] or 0) // SMALL)
    hot = named.where(F.col("n") > many)
    if hot.isEmpty():
        found = rows.join(named, "node")
    else:
        cold = rows.join(F.broadcast(hot.select("node")), "node", "left_anti")
        found = rows.join(F.broadcast(hot), "node").unionByName(cold.join(named.where(F.col("n") <= many), "node"))
    return found.select("doc_id", "node", F.col("least.doc_id").alias("component_id"), "component")


def profile_column(text: Column, width: int, bits: int) -> Column:
    """Of a text's set of shingles: ``node`` (a hash of the set), ``size``, parity ``bits``, and the SimHash of its
    members as ``print`` (node, fp)."""

    @F.arrow_udf("struct<node:long,size:int,bits:binary,print:struct<node:long,fp:binary>>")
    def compute(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py(), width) for t in texts]
        prints = [np.packbits(2 * sum(_bits(_widened(s[at : at + (1 << 14)], bits)).sum(0, np.int64) for at in range(0, len(s), 1 << 14)) > len(s), bitorder="little").tobytes() for s in sets]
        keys = np.array([xxhash.xxh64_intdigest(x) for x in prints], np.uint64).view(np.int64)
        shown = pa.StructArray.from_arrays([pa.array(keys), pa.array(prints, pa.binary())], names=["node", "fp"])
        own = pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([parity(s) for s in sets], pa.binary())
        return pa.StructArray.from_arrays([*own, shown], names=["node", "size", "bits", "print"])

    return compute(text)


def _similar(docs: DataFrame, id_: Column, text: Column, width: int, bits: int, radius: int, accept: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, node), and of each set of shingles (node) its component's least row, as in ``_grouped``.

    Links are pairs of ``similarity``: print links that hold on whole texts, and the pairs between what
    these connect that an exact join finds.
    """

    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    rows = docs.select(id_.alias("doc_id"), F.xxhash64(text).alias("text_key"), profile_column(text, width, bits).alias("p"))
    rows = cut(rows.select("doc_id", "text_key", "p.*"), "prints")
    nodes = cut(rows.groupBy("node").agg(F.min(row).alias("least"), F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.min("print").alias("print")), "distinct")
    prints = cut(nodes.groupBy("print").agg(F.min("node").alias("first")), "different")
    same = nodes.join(prints, "print").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    texts = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text"))

    links = near_links(prints.select(F.col("first").alias("node"), "print.fp"), bits, radius, accept)
    sure = jaccard.verified(links.union(same), nodes, texts, width, similarity)
    clusters = cut(connected_components(sure, "a", "b").withColumnRenamed("node", "member"), "clusters")
    shared = cut(jaccard.prefixes(texts, width, similarity), "prefixes")
    more = jaccard.verified(jaccard.candidates(shared, clusters, similarity), nodes, texts, width, similarity)

    found = connected_components(sure.union(more), "a", "b").withColumnRenamed("node", "member")
    least = found.join(nodes, found.member == nodes.node).groupBy("root").agg(F.min("least").alias("least_all"))
    named = nodes.select("node", "least").join(found.join(least, "root"), F.col("node") == F.col("member"), "left")
    return rows.select("doc_id", "text_key", "node"), named.select("node", F.coalesce("least_all", "least").alias("least"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, bits: int = WIDE_BITS, radius: int = WIDE_RADIUS, accept: int = WIDE_ACCEPT, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest id (null last), then smallest hash
    of its text; of rows equal in both, any one. Texts link whose sets of shingles of ``width`` words
    have a Jaccard similarity of ``similarity`` or more: all such pairs, and no others.

    Nulls, repeated rows and empty tables are treated as in ``near_duplicates``; all columns stay.
    """
    docs, names = numbered(docs)
    id_, text = F.col(names[id_col]), F.col(names[text_col])
    rows, named = _similar(docs, id_, text, width, bits, radius, accept, similarity)
    # What goes is decided on keys: texts move only where a key that stays has several rows.
    keys = rows.groupBy("doc_id", "text_key", "node").agg((F.count("*") > 1).alias("again")).join(named, "node")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    gone = cut(keys.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "again", stays.alias("stays")).where("again or not stays"), "gone")
    n = gone.count()
    side = lambda x: F.broadcast(x) if n <= SMALL else x
    own = lambda x: id_.eqNullSafe(x["_id"]) & (F.xxhash64(text) == x["_key"])
    kept = docs.join(side(gone), own(gone), "left_anti")
    several = gone.where("stays").select("_id", "_key")
    if not several.isEmpty():
        one = docs.join(side(several), own(several)).dropDuplicates(["_id", "_key"]).drop("_id", "_key")
        kept = kept.unionByName(one)
    return restored(kept, names)


def hex_print(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")
