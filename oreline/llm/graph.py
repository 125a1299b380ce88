"""Connected components of an edge table: few edges in one task, more without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm.common import cut

#: Edges up to which one task joins them all, in some 100 MB; rounds over shuffles would be mostly overhead.
FEW = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different nodes of edges between ``a`` and ``b``, and the smallest node that each reaches.

    Each round hooks every root with a smaller neighbour to the smallest one: a component at least
    doubles in two rounds.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        left = x != y
        a, b, x, y = a[left], b[left], x[left], y[left]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return nodes, nodes[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if parts:
        found = joined(*map(np.concatenate, zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root"])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root``: the smallest node that each node of ``edges`` reaches.

    Up to ``FEW`` different edges are joined in one task. Of more, large-star and small-star steps
    alternate until the edges are stars or that few (Kiveris et al., 2014). Each step is a minimum with
    map-side combine and an equi-join that AQE splits where a hub is hot. The edges of each round are a
    table in the shared folder. Self loops and repeated edges do no harm; edges with a null end are
    ignored; no edges give no rows.
    """
    a_, b_ = F.col(a).cast("long"), F.col(b).cast("long")
    stars = edges.select(F.greatest(a_, b_).alias("a"), F.least(a_, b_).alias("b"))
    stars = cut(stars.where(a_.isNotNull() & b_.isNotNull() & (F.col("a") != F.col("b"))).distinct(), "edges")
    before = None
    while (now := _print_of(stars)) != before and now[0]:
        if now[0] <= FEW:
            return cut(stars.repartition(1).mapInArrow(_joined, "node long, root long"), "components")
        before = now
        both = stars.union(stars.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = cut(small.union(least.select("a", "m")).distinct(), "edges")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
