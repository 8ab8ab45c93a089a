"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import gives_back
from tessera.storage import discard, persist

#: The rounds needed grow with the square of the logarithm of a path's length: no list of links needs more.
MAX_ROUNDS = 1000
#: Links that one task thins out.
TASK_LINKS = 1_000_000


class Forest:
    """Union-find over positions of an array."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite a[i] and b[i] for all i."""
        while len(a):
            root = self.roots()
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def thinned(edges: DataFrame) -> DataFrame:
    """Links (a long, b long) that connect what ``edges`` does, but fewer.

    Each task joins the nodes of its links and sends each node once, with the
    least it reaches there. Of n nodes that are all linked with one another
    stay as many as n times the tasks at most, not the square of n.
    """
    edges = persist(edges, "links")
    tasks = max(1, -(-edges.count() // TASK_LINKS))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64), np.empty(0, np.int64)), *((x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches)]
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        forest = Forest(len(nodes))
        forest.link(at[: len(a)], at[len(a) :])
        root = nodes[forest.roots()]
        apart = root != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(root[apart])], ["a", "b"])

    return edges.select("a", "b").repartition(tasks, F.xxhash64("a")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): the least node it reaches.

    Large-star and small-star steps in turn (Kiveris et al., 2014): every
    node's greater neighbours, then its lesser ones and itself, are linked to
    the least. Both keep the components and end in stars around the least
    nodes. Each step only takes minima, which are combined before a shuffle,
    and every round is written to the shared folder. Loops and repeated edges
    do no harm; an empty list gives an empty result.
    """
    links = persist(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        joined = large.join(lower, F.col("a") == F.col("c"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        fresh = persist(small, "edges")
        discard(links)
        links = fresh
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
