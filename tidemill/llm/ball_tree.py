"""Centroid clustering of whole-number vectors, filtered by ball trees.

Components x become floor(SCALE * x). Each task cuts its vectors into runs of at most RUN and builds a metric tree over
each: a node is a ball with its centre, a radius that no vector exceeds, its count, its integer sum and the sum of its squared
lengths; leaves hold the vectors, in the tree's order. The trees are written once to the shared folder. A round sends the
centroids to them: where, by the triangle inequality, every vector of a ball is nearer to one centroid than to any other,
the ball goes there as a whole, by its count and sum; else its halves are looked at, and the vectors of leaves that stay in
doubt are compared exactly. Copies of one vector are one ball of radius 0, however many.

All sums are whole numbers and exact, so neither the order of rows nor the cut into runs changes a result. Each round brings
the sums of k clusters to the driver (see exact.py). A round that moves no centroid ends the loop: later ones would repeat it.

Numbers up to NARROW (for 64 components) are multiplied as doubles without rounding; runs with larger ones, or rounds whose
centroids are larger, use Python's integers and no tree, slower and as exact. distance, cluster_inertia and inertia are null where 64 bits
do not hold them.

Left out: null vectors, those with null or non-finite entries, and those without exactly `width` components. Repeated rows
and ids are vectors of their own; a null id counts as the text `null` in the choice of the first centroids, equal hashes go by the vector. With fewer
vectors than k there are as many centroids as vectors. Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import exact
from tidemill.llm.session import new_folder, settled

SCALE, WIDTH, CLUSTERS, ROUNDS = 1024, 64, 8, 10
#: Vectors of a tree, and of a leaf.
RUN, LEAF = 8192, 32
#: Sums of RUN squared lengths stay below 2**62, squared distances below 2**53.
ROOM = 46
_SCHEMA = "ids array<{kind}>, wide boolean, points binary, starts array<int>, ends array<int>, low array<int>, high array<int>, radii array<double>, sums binary, squares array<long>"


def narrow(width: int) -> float:
    """Largest number that doubles multiply exactly in vectors of this width."""
    return float(1 << (ROOM - math.ceil(math.log2(max(width, 1)))) // 2)


def whole(x: float) -> int:
    """floor(SCALE * x), exactly."""
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(SCALE * x)


class Tree:
    """A ball tree over rows of whole numbers (doubles), which it puts in an order where each node's rows follow one another.

    low and high are the halves of a node, -1 at a leaf; the root is node 0.
    """

    def __init__(self, points: np.ndarray) -> None:
        order = np.arange(len(points))
        nodes, todo = [], [(0, len(points), -1, 0)]
        while todo:
            a, z, parent, side = todo.pop()
            own = points[order[a:z]]
            total = own.sum(axis=0)
            far = ((own - np.floor(total / (z - a))) ** 2).sum(axis=1)
            # Rounded up, so that no vector lies outside.
            radius = math.sqrt(far.max()) * (1 + 1e-12)
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            nodes.append([a, z, -1, -1, radius, total, (own**2).sum(axis=1).astype(np.int64).sum()])
            pivot = own[far.argmax()]
            other = ((own - pivot) ** 2).sum(axis=1)
            if z - a > LEAF and other.any():
                along = own @ (own[other.argmax()] - pivot)
                half = (z - a) // 2
                order[a:z] = order[a:z][np.argpartition(along, half)]
                me = len(nodes) - 1
                todo += [(a, a + half, me, 0), (a + half, z, me, 1)]
        self.order = order
        columns = list(zip(*nodes, strict=True))
        self.starts, self.ends, self.low, self.high = (np.array(c, np.int32) for c in columns[:4])
        self.radii = np.array(columns[4], np.float64)
        self.sums = np.stack(columns[5]).astype(np.int64)
        self.squares = np.array(columns[6], np.int64)


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows of narrow whole numbers, each a sum of whole numbers below 2**53 and so exact."""
    return (points**2).sum(axis=1)[:, None] - 2 * (points @ centroids.T) + (centroids**2).sum(axis=1)


class Run:
    """One row of the trees' table."""

    def __init__(self, row: pa.RecordBatch, k: int, width: int) -> None:
        get = lambda name: row.column(row.schema.get_field_index(name))[k]
        self.wide, self.ids = get("wide").as_py(), get("ids").values
        kind = np.float64 if self.wide else np.int32
        self.points = np.frombuffer(get("points").as_buffer(), kind).reshape(-1, width).astype(np.float64)
        if not self.wide:
            self.starts, self.ends, self.low, self.high, self.radii, self.squares = (get(c).values.to_numpy() for c in ("starts", "ends", "low", "high", "radii", "squares"))
            self.sums = np.frombuffer(get("sums").as_buffer(), np.int64).reshape(-1, width)

    def _in_full(self, centroids: list[list[int]]) -> tuple[np.ndarray, list[int], list[list[int]]]:
        """(cluster, squared distance, numbers) of each vector by Python's integers."""
        numbers = [[whole(x) for x in p] for p in self.points.tolist()] if self.wide else [[int(x) for x in p] for p in self.points.tolist()]
        best = [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(centroids)) for p in numbers]
        return np.array([j for _, j in best], np.int64), [d for d, _ in best], numbers

    def assigned(self, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
        """(cluster, squared distance) of each vector."""
        if not self._fits(centroids):
            return self._in_full(centroids)[:2]
        far = squared_distances(self.points, np.array(centroids, np.float64))
        best = far.argmin(axis=1)
        return best, far[np.arange(len(far)), best].astype(np.int64).tolist()

    def _fits(self, centroids: list[list[int]]) -> bool:
        return not self.wide and max((abs(v) for c in centroids for v in c), default=0) <= narrow(self.points.shape[1])

    def gathered(self, centroids: list[list[int]]) -> tuple[list[list[int]], int]:
        """([count, sum of squared distances, sums of components] of each cluster, vectors that were looked at one by one)."""
        width, k = self.points.shape[1], len(centroids)
        out = [[0] * (2 + width) for _ in centroids]
        if not self._fits(centroids):
            for j, d, p in zip(*self._in_full(centroids), strict=True):
                out[j] = [out[j][0] + 1, out[j][1] + d, *(a + b for a, b in zip(out[j][2:], p, strict=True))]
            return out, len(self.points)
        at = np.array(centroids, np.float64)
        counts = (self.ends - self.starts).astype(np.int64)
        squared = squared_distances(np.floor(self.sums / counts[:, None]), at)
        away = np.sqrt(squared)
        best = squared.argmin(axis=1)
        # The centroids that may be nearest to some vector of the ball; a margin covers the rounding of roots and radii.
        reach = away[np.arange(len(best)), best] + 2 * self.radii
        open_ = (away <= (reach * (1 + 1e-9) + 1e-9)[:, None]).sum(axis=1) > 1
        # A ball of radius 0 is one vector: the centre, exactly.
        open_ &= self.radii > 0
        closed, leaves, front = [], [], np.zeros(1, np.int64)
        while len(front):
            closed.append(front[~open_[front]])
            front = front[open_[front]]
            leaf = self.low[front] < 0
            leaves.append(front[leaf])
            front = np.concatenate([self.low[front[~leaf]], self.high[front[~leaf]]]).astype(np.int64)
        closed, leaves = np.concatenate(closed), np.concatenate(leaves)
        rows = np.concatenate([np.arange(self.starts[v], self.ends[v]) for v in leaves.tolist()]) if len(leaves) else np.empty(0, np.int64)
        near = squared_distances(self.points[rows], at)
        label = near.argmin(axis=1)
        for j in range(k):
            balls, own = closed[best[closed] == j], rows[label == j]
            sums = self.sums[balls].sum(axis=0) + self.points[own].sum(axis=0).astype(np.int64)
            n, held = int(counts[balls].sum()), [int(v) for v in self.sums[balls].sum(axis=0)]
            # Of whole balls: the sum of |x|**2 - 2 x c + |c|**2.
            inertia = sum(map(int, self.squares[balls])) - 2 * sum(a * b for a, b in zip(held, centroids[j], strict=True)) + n * sum(v * v for v in centroids[j])
            out[j] = [n + len(own), inertia + sum(map(int, near[label == j, j])), *map(int, sums)]
        return out, len(rows)


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(ids, values) of at most RUN vectors, whatever the size of the batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        for at in range(0, b.num_rows, RUN):
            held.append(b.slice(at, RUN))
            while sum(x.num_rows for x in held) >= RUN:
                whole_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield whole_.slice(0, RUN)
                held = [whole_.slice(RUN)] if whole_.num_rows > RUN else []
    if any(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def plant(vectors: DataFrame, width: int = WIDTH, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each run of vectors: their ids and numbers in the tree's order, and the nodes. Vectors must be usable and of this width."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    schema = _SCHEMA.format(kind=rows.schema["vec_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        for b in _runs(batches, width):
            values = exact.matrix(b.column(1), width)
            numbers = np.floor(SCALE * values) if np.abs(values).max(initial=0) < 1 << 40 else None
            wide = numbers is None or np.abs(numbers).max(initial=0) > narrow(width)
            if wide:
                order, nodes, points = np.arange(len(values)), ([], [], [], [], [], b"", []), values.tobytes()
            else:
                t = Tree(numbers)
                order, points = t.order, numbers[t.order].astype(np.int32).tobytes()
                nodes = (t.starts, t.ends, t.low, t.high, t.radii, t.sums.tobytes(), t.squares)
            ids = b.column(0).take(pa.array(order))
            *small, radii, sums, squares = nodes
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([wide]), pa.array([points]), *(one(s, pa.int32()) for s in small), one(radii, pa.float64()), pa.array([sums]), one(squares, pa.int64())],
                names=["ids", "wide", "points", "starts", "ends", "low", "high", "radii", "sums", "squares"],
            )

    return rows.mapInArrow(run, schema)


def first_centroids(vectors: DataFrame, k: int, seed: int, vec_id: str, vector: str) -> list[list[int]]:
    """The numbers of the k vectors of the smallest sha256 of `seed:vec_id`."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit("null"))), 256)
    return [[whole(x) for x in r["v"]] for r in vectors.select(mark.alias("mark"), F.col(vector).alias("v")).orderBy("mark", "v").limit(k).collect()]


def _totals(trees: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """[count, inertia, sums] of each cluster over all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (len(centroids) * (2 + width))
        for b in batches:
            for k in range(b.num_rows):
                own = Run(b, k, width).gathered(centroids)[0]
                total = [x + y for x, y in zip(total, (v for c in own for v in c), strict=True)]
        yield exact.limbs(total)

    found = exact.summed(trees.mapInArrow(run, exact.SCHEMA), len(centroids) * (2 + width))
    return [found[j * (2 + width) : (j + 1) * (2 + width)] for j in range(len(centroids))]


def cluster_vectors(docs: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, width: int = WIDTH, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster int, distance, cluster_inertia, inertia long, centroid_sha256): a row for each vector, squared distances.

    The centroids start as the k vectors of the smallest sha256 of `seed:vec_id`. A round assigns every vector to the nearest
    centroid (ties: the smaller number), then each centroid that has vectors becomes the floor of their mean.
    """
    rows = docs.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where(exact.usable("v") & (F.size("v") == width))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(rows, k, seed, "vec_id", "v")
    if not centroids:
        return docs.sparkSession.createDataFrame([], schema)
    folder = new_folder(docs.sparkSession, "trees")
    plant(rows, width, "vec_id", "v").write.parquet(folder)
    trees = docs.sparkSession.read.parquet(folder)
    for _ in range(rounds):
        moved = [[s // n for s in sums] if n else old for (n, _, *sums), old in zip(_totals(trees, centroids, width), centroids, strict=True)]
        if moved == centroids:
            break
        centroids = moved
    own = [c[1] for c in _totals(trees, centroids, width)]
    inertia = exact.as_long(sum(own))
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                one = Run(b, at, width)
                label, far = one.assigned(centroids)
                j = pa.array(label)
                yield pa.RecordBatch.from_arrays(
                    [one.ids, j.cast(pa.int32()), pa.array([exact.as_long(d) for d in far], pa.int64()), pa.array([exact.as_long(v) for v in own], pa.int64()).take(j), pa.array([inertia] * len(far), pa.int64()), pa.array(marks).take(j)],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return settled(trees.mapInArrow(run, schema), folder)
