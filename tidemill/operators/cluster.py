"""Two-dimensional k-means (Lloyd).

Assignment is a projection, so it moves nothing. Up to LITERALS centres stand in the plan one by one; more of them
become one constant, an array that each point scans, so the plan's size does not grow with them. From INDEXED on, a grid over
the points holds for each of its cells the centres that can be nearest to a point there, and a point scans those of its cell.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.graph import as_float

Centres = list[tuple[float, float]]
SEEDS: Centres = [(0.0, 0.0), (7.0, 7.0)]
#: Centres that are expressions of their own; more are one constant array.
LITERALS = 32
#: Centres from which a grid is used, and cells of a grid at most.
INDEXED, MOST_CELLS = 256, 4096


@dataclass(frozen=True)
class CentreGrid:
    """A grid of side x side cells from (x0, y0), each of width x height; near: for each cell, row by row, the centres that can be nearest to a point in it."""

    x0: float
    y0: float
    width: float
    height: float
    side: int
    near: list[list[int]]


def centre_grid(centres: Centres, x0: float, y0: float, x1: float, y1: float) -> CentreGrid:
    """The grid over x0..x1, y0..y1 for these centres.

    A centre is left out of a cell only if it is farther from the cell's nearest point than some other centre is from
    its farthest one; a margin covers rounding.
    """
    side = int(np.clip(round((4 * len(centres)) ** 0.5), 1, round(MOST_CELLS**0.5)))
    width, height = max(x1 - x0, 1e-9) / side, max(y1 - y0, 1e-9) / side
    at = np.array(centres, np.float64)
    near = []
    for row in range(side):
        # Cells are taken a little larger than they are.
        low = np.stack([x0 + np.arange(side) * width, np.full(side, y0 + row * height)], axis=1)[:, None] - 1e-9 * (width + height)
        high = low + [width, height] + 2e-9 * (width + height)
        inside = np.maximum(np.maximum(low - at, at - high), 0)
        least, most = np.sqrt((inside**2).sum(axis=2)), np.sqrt((np.maximum(np.abs(at - low), np.abs(high - at)) ** 2).sum(axis=2))
        near += [np.flatnonzero(keep).tolist() for keep in least <= most.min(axis=1, keepdims=True) * (1 + 1e-9) + 1e-9]
    return CentreGrid(x0, y0, width, height, side, near)


def _in_cells(points: DataFrame, centres: Centres, cutoff: float | None) -> DataFrame:
    """points with `cluster` by a grid over their range, which one aggregate finds. Coordinates that are no numbers scan all centres."""
    x, y = F.col("x"), F.col("y")
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    x0, x1, y0, y1 = points.agg(*(f(finite(F.nanvl(c, F.lit(None)))) for c in (x, y) for f in (F.min, F.max))).first()
    rows = [{"i": i, "x": float(cx), "y": float(cy)} for i, (cx, cy) in enumerate(centres)]
    every = F.from_json(F.lit(json.dumps(rows)), "array<struct<i:int,x:double,y:double>>")
    if x0 is None or y0 is None:
        return points.withColumn("cluster", _nearest(x, y, every, cutoff))
    grid = centre_grid(centres, x0, y0, x1, y1)
    cells = F.from_json(F.lit(json.dumps([[rows[i] for i in own] for own in grid.near])), "array<array<struct<i:int,x:double,y:double>>>")
    inside = x.between(x0, x1) & y.between(y0, y1)
    step = lambda c, low, size: F.least(F.floor((c - F.lit(low)) / F.lit(size)), F.lit(grid.side - 1))
    cell = F.when(inside, step(y, grid.y0, grid.height) * grid.side + step(x, grid.x0, grid.width) + 1)
    return points.withColumn("cluster", _nearest(x, y, F.coalesce(F.try_element_at(cells, cell.cast("int")), every), cutoff))


def _nearest(x: Column, y: Column, centres: Column | Centres, cutoff: float | None) -> Column:
    """Number of the nearest centre; equal distances go to the lower one. With a cut-off, a point that is not nearer to any goes to 0."""
    away = lambda cx, cy: F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))
    if isinstance(centres, list):
        best = F.array_min(F.array(*(F.struct(away(F.lit(cx), F.lit(cy)).alias("d"), F.lit(i).alias("i")) for i, (cx, cy) in enumerate(centres))))
    else:
        best = F.array_min(F.transform(centres, lambda c: F.struct(away(c["x"], c["y"]).alias("d"), c["i"].alias("i"))))
    near = best["i"] if cutoff is None else F.when(best["d"] < cutoff, best["i"]).otherwise(0)
    return F.when(x.isNotNull() & y.isNotNull(), near)


def kmeans_assign(points: DataFrame, centres: Centres, cutoff: float | None = None, literals: int = LITERALS, indexed: int = INDEXED) -> DataFrame:
    """points with `cluster`, the nearest centre; null coordinates give null. Without centres no point is assigned: no rows."""
    if not centres:
        return points.where("false").withColumn("cluster", F.lit(None).cast("int"))
    x, y = F.col("x"), F.col("y")
    if len(centres) <= literals:
        return points.withColumn("cluster", _nearest(x, y, centres, cutoff))
    if len(centres) >= indexed:
        return _in_cells(points, centres, cutoff)
    shown = json.dumps([{"i": i, "x": float(cx), "y": float(cy)} for i, (cx, cy) in enumerate(centres)])
    return points.withColumn("cluster", _nearest(x, y, F.from_json(F.lit(shown), "array<struct<i:int,x:double,y:double>>"), cutoff))


def kmeans_step(points: DataFrame, centres: Centres, cutoff: float | None = None) -> DataFrame:
    """(cluster, x, y, n): means of the assigned points, for the clusters that have some."""
    return kmeans_assign(points, centres, cutoff).where("cluster is not null").groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def kmeans(points: DataFrame, centres: Centres = SEEDS, max_iter: int = 100, cutoff: float | None = None, progress: Callable[[int, Centres], None] | None = None) -> tuple[DataFrame, Centres]:
    """The last step's rows and the carried centres. Stops when no centre moves, or after max_iter steps.

    Each step brings k rows to the driver, and the last step's are the result (k rows, a local table), so the points are
    not read again. Centres are rounded to float between steps; a cluster without points keeps its centre. progress is
    called with the number of each step and its centres. Without centres the result is empty.
    """
    state = [(as_float(x), as_float(y)) for x, y in centres]
    step = kmeans_step(points, state, cutoff)
    schema, rows = step.schema, []
    for k in range(max_iter if state else 0):
        rows = kmeans_step(points, state, cutoff).collect()
        moved = list(state)
        for row in rows:
            moved[row["cluster"]] = (as_float(row["x"]), as_float(row["y"]))
        if progress:
            progress(k + 1, moved)
        if moved == state:
            break
        state = moved
    return points.sparkSession.createDataFrame(rows, schema), state
