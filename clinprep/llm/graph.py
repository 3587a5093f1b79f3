"""Connected components of large sparse graphs by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinprep.sources.shared import store

#: A task hands on its links whenever so many nodes are in its forest.
FOREST_NODES = 500_000


class Forest:
    """Union-find over the links of one task: any number of links in, at most one edge a node out."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = up.setdefault(x, x)
        while up[r] != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def link(self, left, right) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def full(self) -> bool:
        return len(self.up) >= FOREST_NODES

    def drain(self) -> pa.RecordBatch:
        nodes = [x for x in self.up if self.root(x) != x]
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.up[x] for x in nodes], pa.int64())], ["a", "b"])
        self.up = {}
        return out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        forest.link(*(np.asarray(batch.column(n)) for n in ("a", "b")))
        if forest.full():
            yield forest.drain()
    yield forest.drain()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: longs, not null); component is its smallest node.

    Each round maps every edge's larger end to the smallest neighbour of the other end (large-star, then
    small-star); rounds follow until the edges are stars around the smallest nodes, a number of them
    logarithmic in the size of a component. Rounds are written tables, so lineage stays short; smallest
    neighbours are too, which lets adaptive execution split the edges of a hub when they meet.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "edges")
    while True:
        # a star: no centre is a leaf, no leaf has two centres
        leaves = edges.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
        deep = edges.select(F.col("b").alias("a")).join(leaves, "a", "left_semi").limit(1)
        forked = leaves.filter("lo < hi").select("a").limit(1)
        if not deep.unionByName(forked).take(1):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = store(large, "large-star")
        low = store(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        pairs = large.join(low, "a")
        small = pairs.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = store(small, "small-star")
