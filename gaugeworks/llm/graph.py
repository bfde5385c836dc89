"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is a partial-aggregated minimum and a join. The edges of hot nodes (more than one in 2500 of all
edges, so at most 5000 nodes) meet the broadcast minima of those nodes and are never shuffled to one task; the
lineage is cut after each round, and the round before is deleted. Parts of the edges are first reduced to
spanning forests (`forest`), which bounds them by the nodes seen in a part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


class Unions:
    """Union-find over integers; the smallest member stands for a set."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (y := self.up.get(root, root)) != root:
            root = y
        while (y := self.up.get(x, x)) != root:
            self.up[x] = root
            x = y
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.up) if self.find(x) != x]


def forest(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> edges with the same components, at most one for each node of a partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Unions()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                sets.join(a, b)
        links = np.array(sets.links(), np.int64).reshape(-1, 2)
        for k in range(0, len(links), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(links[k : k + 50_000, 0]), pa.array(links[k : k + 50_000, 1])], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (a, b) with m, the least b of their a. Edges of hot nodes are spread by their other end and meet a broadcast."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
    hot = low.where(F.col("c") > max(64, total // 2500)).select("a", F.col("m").alias("mh"))
    marked = edges.join(F.broadcast(hot), "a", "left")
    marked = marked.select("a", "b", "mh", F.when(F.col("mh").isNull(), F.col("a")).otherwise(F.col("b")).alias("k"), F.col("mh").isNull().alias("cold"))
    return marked.join(low.select(F.col("a").alias("k"), F.lit(True).alias("cold"), "m"), ["k", "cold"], "left").select("a", "b", F.coalesce("mh", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node reachable, for every node on an edge. The number of rounds grows with the logarithm of the longest path."""
    e = written(forest(edges.where("a != b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = e.union(e.select("b", "a"))
        total = 2 * e.count()
        large = written(_with_least(both, total).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        small = _with_least(large, total).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        new = written(small)
        dropped(e, large)
        # a forest of stars: no node is both a root and a leaf, and no leaf has two edges
        sides = new.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")), F.struct(F.col("b").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))))
        if sides.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).where("leaf > 1 or (leaf > 0 and root > 0)").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("component"))
        e = new
