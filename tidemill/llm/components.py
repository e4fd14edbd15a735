"""Connected components of a graph given by its edges, without bringing any of it to the driver.

Edges first shrink to a forest within each task (union-find). At most `one_task` forest edges (a count that
is checked) are finished by one more task; beyond that, large-star and small-star steps alternate until
every component is a star around its smallest node. Each round is written to the shared folder, which cuts
the lineage. A node with very many edges is handled by an aggregate with map-side combine and a join that
Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.session import cut


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True

    def edges(self) -> Iterable[tuple[int, int]]:
        """(node, root) of the nodes that aren't roots."""
        return ((x, r) for x in list(self.parent) if (r := self.root(x)) != x)


#: Nodes that a task's forest holds before it is passed on.
FOREST_NODES = 500_000


def _grown(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        pairs = np.array(list(forest.edges()), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    forest = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.union(x, y)
        if len(forest.parent) > limit:
            yield out()
            forest = Forest()
    yield out()


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _grown(batches, FOREST_NODES)


def _one_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _grown(batches, float("inf"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is joined to the smallest of u and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are joined to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


#: Forest edges (16 bytes each) that one task may finish.
ONE_TASK = 1_000_000


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for each node of an edge: root is the smallest node that it is connected with.

    edges: two long columns; null ends and loops are ignored; repeated and reversed edges do no harm.
    """
    a, b = edges.columns
    plain = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    state = cut(plain.mapInArrow(_local_forests, "u long, v long"))
    if state.count() <= one_task:
        state = cut(state.coalesce(1).mapInArrow(_one_forest, "u long, v long"))
    else:
        state = _stars(cut(state.distinct()))
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))


def _stars(state: DataFrame) -> DataFrame:
    """Large-star and small-star rounds until nothing changes."""
    mark = None
    while True:
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return state
        mark = now
        state = cut(_small_star(_large_star(state).where("u <> v").distinct()))
