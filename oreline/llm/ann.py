"""Nearest neighbours by inner product, exactly: an inverted file of coarse centroids whose lists know how
far their entries reach.

Centroids are fitted on a bounded sample; every row is indexed. Copies of a vector are one entry, with
its least ids. What a query scores in the sample bounds its last place from below, a list's centroid,
radius and largest norm bound its entries from above: only lists that cannot hold one of the best are
passed by. Lists are dealt to groups of a bounded number of entries, hot ones to several; a query goes
to each group that has lists it needs and is scored there a matrix at a time, so its work is the
lists that the bounds leave: few where vectors gather, all of them where they are spread evenly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreline.llm.common import cut

#: Rows that centroids are fitted on (those of least hash), most lists, entries of a group; the components
#: that the sample and a group hold at most.
SAMPLE, LISTS, BLOCK, SAMPLE_SIZE, BLOCK_SIZE = 16_384, 4_096, 16_384, 1 << 22, 1 << 20


def lists_of(coarse: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector."""
    return np.argmax(v @ coarse.T - (coarse**2).sum(1) / 2, 1)


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))


def kmeans(v: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    random = np.random.default_rng(seed)
    centre = v[random.choice(len(v), min(k, len(v)), replace=False)].copy()
    for _ in range(rounds):
        of = np.concatenate([np.argmax(v[i : i + 4096] @ centre.T - (centre**2).sum(1) / 2, 1) for i in range(0, len(v), 4096)])
        n = np.bincount(of, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, of, v)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centre[n == 0] = v[random.choice(len(v), int((n == 0).sum()))]
    return centre


def usable(vector: Column, size: int) -> Column:
    """Neither null nor zero, of the common length, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


@dataclass
class Bounds:
    """What the lists hold at most; ``scale`` is the largest norm of all."""

    coarse: np.ndarray  # list x dimension
    radius: np.ndarray  # the largest distance of an entry from its list's centroid
    norm: np.ndarray
    scale: float

    def slack(self, q: np.ndarray) -> np.ndarray:
        """How far a sum in another order may be off."""
        return 4 * q.shape[1] * np.finfo(float).eps * norms(q) * self.scale

    def needed(self, q: np.ndarray, least: np.ndarray, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Query x list: whether the list may have an entry that scores ``least``. What overflows is needed."""
        size = norms(q)[:, None]
        most = np.minimum(q @ self.coarse[of].T + size * self.radius[of], size * self.norm[of])
        return ~(most < least[:, None])


def _grouped(start: Callable, answer: Callable, names: list[str]):
    """For ``mapInArrow`` over rows sorted by group and kind: ``start`` makes a state of a group's entries (kind 0),
    to which ``answer`` gives each batch of its queries (kind 1). Queries are never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, state = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([batch.column(c).to_numpy() for c in ("group", "kind")])
            starts = [0, *(np.flatnonzero((now[:, 1:] != now[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if now[0, i] != group:
                    group, held, state = now[0, i], [], None
                if now[1, i] == 0:
                    held.append(batch.slice(i, j - i))
                elif held:
                    state = start(pa.Table.from_batches(held).combine_chunks()) if state is None else state
                    for at in range(i, j, 128):
                        found = answer(state, batch.slice(at, min(128, j - at)))
                        if found is not None and len(found[0]):
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    return run


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    return np.stack([np.frombuffer(x, kind) for x in column.to_pylist()])


def _scores(shared, kept: int):
    """The ``kept`` best of a group for each query: entries (list, id, first, v), queries (id, v, least)."""

    def start(rows: pa.Table) -> tuple:
        order = np.argsort(of := rows["list"].to_numpy(), kind="stable")
        lists, begin = np.unique(of[order], return_index=True)
        return rows["id"].to_numpy()[order], rows["first"].to_numpy()[order], _unpacked(rows["v"], np.float64)[order], lists, [*begin.tolist(), len(of)]

    def answer(state: tuple, asked: pa.RecordBatch) -> list[np.ndarray]:
        ids, first, v, lists, begin = state
        bounds: Bounds = shared.value
        q, least, own = _unpacked(asked.column("v"), np.float64), asked.column("least").to_numpy(), asked.column("id").to_numpy()
        with np.errstate(all="ignore"):
            needed = bounds.needed(q, least, lists)
            if needed.all():
                score = q @ v.T
            else:
                score = np.full((len(q), len(v)), -np.inf)
                for x, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                    if len(ks := np.flatnonzero(needed[:, x])):
                        score[ks, a:b] = q[ks] @ v[a:b].T
            near, slack = ~(score < least[:, None]), bounds.slack(q)
            for k in np.flatnonzero(near.sum(1) > 4 * kept):
                near[k] &= ~(score[k] < np.partition(score[k], -kept)[-kept] - slack[k])
            k, j = np.nonzero(near)
            some = max(1, BLOCK_SIZE // q.shape[1])
            exact = np.concatenate([np.zeros(0), *[(v[j[at : at + some]] * q[k[at : at + some]]).sum(1) for at in range(0, len(k), some)]])
        order = np.lexsort((first[j], -exact, k))
        k, j, exact = k[order], j[order], exact[order]
        keep = np.arange(len(k)) - np.searchsorted(k, k) < kept
        return [own[k[keep]], ids[j[keep]], first[j[keep]], exact[keep]]

    return _grouped(start, answer, ["query", "id", "first", "score"])


def nearest(
    vectors: DataFrame, every: int = 20, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, lists: int | None = None, probes: int | None = None, parts: int | None = None, rerank: int | None = None
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` nearest of each row whose id ``every`` divides.

    Score is the inner product in double precision on the original vectors; ties go to the smaller
    id. Rows with null ids, and vectors that are null, zero, of another length than most, or
    hold null or non-finite components, take no part. Rows that repeat an id are candidates each,
    but not of a query with that id. Empty tables give no rows. lists: by default as many as
    the root of the rows. Entries go by a hash of their vector (n share some with chance
    n * n / 2**65). probes, parts, rerank: of a search that was not exact; they change nothing.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null")
    some = rows.where(F.size("v") > 0).select(F.size("v")).groupBy("size(v)").count().orderBy(F.desc("count"), F.desc("size(v)")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if some is None:
        return empty
    size, kept = some[0], 2 * top + 1
    rows = rows.where(usable(F.col("v"), size)).withColumn("node", F.xxhash64("v"))
    same = Window.partitionBy("node").orderBy("id")
    # Of the copies of a vector a query sees the least ids only; ids of queries stay all.
    copies = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= kept)
    copies = cut(copies.select("node", "id", "nth", F.when(F.col("nth") == 1, F.col("v")).alias("v")), "copies")
    entries = copies.where("nth = 1").select(F.col("node").alias("id"), F.col("id").alias("first"), "v")
    n = entries.count()
    if not n:
        return empty
    sample = min(sample, max(kept, SAMPLE_SIZE // size))
    picked = np.stack(list(entries.orderBy("id").limit(sample).select("v").toPandas()["v"]))  # ids of entries are hashes
    with np.errstate(all="ignore"):
        coarse = kmeans(picked, min(lists or int(np.sqrt(n)) + 1, LISTS, len(picked)))
    centres, known = spark.sparkContext.broadcast(coarse), spark.sparkContext.broadcast(picked)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), size)
            with np.errstate(all="ignore"):
                of = lists_of(centres.value, v) if len(v) else np.zeros(0, np.int64)
                far = norms(v - centres.value[of])
                columns = [batch.column(0), batch.column(1), pa.array(of.astype(np.int32)), pa.array(far), pa.array(norms(v)), pa.array([x.tobytes() for x in v], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "first", "list", "far", "norm", "v"])

    placed = cut(entries.mapInArrow(place, "id long, first long, list int, far double, norm double, v binary"), "lists")
    counts, radius, norm = np.zeros(len(coarse), np.int64), np.zeros(len(coarse)), np.zeros(len(coarse))
    for r in placed.groupBy("list").agg(F.count("*"), F.max("far"), F.max("norm")).collect():  # at most one row a list
        counts[r[0]], radius[r[0]], norm[r[0]] = r[1], r[2], r[3]
    # Distances are rounded, of long vectors far from zero too: more than they can be off is added.
    shared = spark.sparkContext.broadcast(Bounds(coarse, radius + 1e-9 * (radius + norm), norm * (1 + 1e-9), float(norm.max())))
    block = min(BLOCK, max(256, BLOCK_SIZE // size))
    first, blocks, used, room = [], [], 0, 0
    for c in counts.tolist():  # lists in turn share a group up to ``block`` entries; a longer one has several
        blocks.append(max(1, -(-c // block)))
        if c > room or not used:
            first.append(used)
            used, room = used + blocks[-1], block - c if c <= block else 0
        else:
            first.append(used - 1)
            room -= c
    literal = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("list") + 1)
    group = (literal(first) + F.pmod(F.xxhash64("id", F.lit(3)), literal(blocks))).cast("int")
    placed = placed.withColumn("group", group)
    of_list = np.repeat(np.arange(len(coarse)), blocks)  # the lists of the groups, by group
    in_group = np.concatenate([np.arange(a, a + m) for a, m in zip(first, blocks, strict=True)])
    begins = np.flatnonzero(np.diff(in_group, prepend=-1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q, least = _unpacked(part.column(1), np.float64), np.full(part.num_rows, -np.inf)
                with np.errstate(all="ignore"):
                    if len(known.value) > kept:
                        least = np.partition(q @ known.value.T, -kept, 1)[:, -kept] - shared.value.slack(q)
                    goes = np.logical_or.reduceat(shared.value.needed(q, least)[:, of_list], begins, axis=1)
                k, g = np.nonzero(goes)
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), part.column(0).take(pa.array(k)), part.column(1).take(pa.array(k)), pa.array(least[k])], names=["group", "id", "v", "least"])

    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "node")
    queries = cut(queries, "queries")
    asking = placed.join(queries.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("id", "v")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sent = asking.mapInArrow(ask, "group int, id long, v binary, least double")
    both = placed.select("group", "id", "first", "list", "v").withColumn("kind", F.lit(0)).unionByName(sent.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(tasks, "group").sortWithinPartitions("group", "kind")
    scored = both.mapInArrow(_scores(shared, kept), "query long, id long, first long, score double")

    down = F.desc(F.nanvl("score", F.lit(float("-inf"))))
    best = scored.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(down, "first"))).where(F.col("nth") <= kept)
    ids = copies.select(F.col("node").alias("id"), F.col("id").alias("vec_id"))
    each = best.join(ids, "id").withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(down, "vec_id"))).where(F.col("nth") <= kept)
    found = queries.join(each, F.col("node") == F.col("query")).where("vec_id != query_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(down, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
