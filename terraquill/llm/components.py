"""Connected components of an edge table by alternating star contractions; edges stay distributed throughout.

Each task first contracts its own edges to stars, in pieces of HELD edges, so few rounds over all edges are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquill.llm.runtime import counted

HELD = 500_000


class Forest:
    """Union-find; the root of a tree is its least node."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were in two trees until now."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def stars(forest: Forest) -> pa.RecordBatch:
        nodes = list(forest.above)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], ["u", "v"])

    forest, held = Forest(), 0
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(u, v)
        held += len(batch)
        if held >= HELD:
            yield stars(forest)
            forest, held = Forest(), 0
    yield stars(forest)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node links its larger (or smaller) neighbours to the least node that it knows."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("x"))
    both = both.union(edges.select(F.col("v").alias("n"), F.col("u").alias("x"))) if large else both
    least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
    linked = both.join(least, "n")
    if large:
        out = linked.where("x > n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("x").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge table (u, v). Null ends drop an edge."""
    state = [F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    e = edges.select("u", "v").where("u <> v").mapInArrow(_contracted, "u long, v long").distinct()
    e, now = counted(e, *state)
    last = None
    while now.rows and now != last:
        last = now
        e, now = counted(_stars(_stars(e, True), False), *state)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
