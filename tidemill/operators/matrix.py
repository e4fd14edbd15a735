"""Sparse matrices as (i, j, v) cells; an absent cell is 0. Values accumulate as 64-bit integers.

matrix_multiply joins cells; matrix_multiply_tiled gathers them into square tiles of TILE cells a side, which are dealt to a
grid of tasks and multiplied there. It moves a tile where the join moves each product.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_add(*matrices: DataFrame) -> DataFrame:
    """Cell-wise sum of any number of matrices."""
    cells = reduce(DataFrame.unionByName, (m.select("i", "j", F.col("v").cast("long").alias("v")) for m in matrices))
    return cells.groupBy("i", "j").agg(F.sum("v").alias("v"))


def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """a times b: an equi-join on the inner index, then a sum for each cell; cells without a product are absent.

    No cell is replicated to the output's rows or columns. Repeated cells of one matrix add up.
    """
    left = a.select("i", F.col("j").alias("k"), F.col("v").cast("long").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").cast("long").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


#: Cells that a task gathers into tiles at once.
GATHERED = 1 << 19
#: Cells along a tile's side (offsets within it fit a byte); cells of both sides that a place of the grid should get; most places that one tile is sent to.
TILE, PLACE_CELLS, MOST_SENT = 256, 2_000_000, 32


@dataclass(frozen=True)
class Grid:
    """Places (row, column, inner) to which tiles are dealt in turn by their numbers. A tile of the left matrix is sent to `columns` places, one of the right matrix to `rows`."""

    rows: int
    columns: int
    inner: int


def grid_for(left: int, right: int, rows: int, columns: int, inner: int, place_cells: int = PLACE_CELLS, most_sent: int = MOST_SENT, tasks: int = 1) -> Grid:
    """The grid for so many cells on each side and so many tiles along the result's rows, its columns and the inner index.

    The inner index is cut first, which sends nothing twice, into `tasks` at least; where places would still get too many cells, rows and columns are cut, up to most_sent each.
    """
    wanted = max(1, -(-(left + right) // place_cells))
    cut = min(inner, max(wanted, tasks))
    side = 1
    while cut * side < wanted and side < most_sent and side < max(rows, columns):
        side *= 2
    return Grid(min(side, rows), min(side, columns), cut)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells as tiles: (row, column, cells binary), a row for each tile of GATHERED cells. Cells: offsets of one byte, then values of eight."""
    held: list[pa.RecordBatch] = []
    for b in itertools.chain(batches, [None]):
        if b is not None and b.num_rows:
            held.append(b)
        if not held or b is not None and sum(x.num_rows for x in held) < GATHERED:
            continue
        i, j, v = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in "ijv")
        held = []
        order = np.lexsort((j // TILE, i // TILE))
        i, j, v = i[order], j[order], v[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] // TILE != i[:-1] // TILE) | (j[1:] // TILE != j[:-1] // TILE)
        at = np.flatnonzero(new)
        edges = [*at.tolist(), len(i)]
        low = np.stack([i % TILE, j % TILE], axis=1).astype(np.uint8)
        packed = [low[a:z].tobytes() + v[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(i[at] // TILE), pa.array(j[at] // TILE), pa.array(packed, pa.binary())], names=["row", "col", "cells"])


def _cells_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, column offsets, values) of a tile's parts."""
    n = [len(p) // 10 for p in parts]
    low = np.concatenate([np.frombuffer(p, np.uint8, 2 * k) for p, k in zip(parts, n, strict=True)]).reshape(-1, 2).astype(np.int64)
    return low[:, 0], low[:, 1], np.concatenate([np.frombuffer(p, np.int64, k, 2 * k) for p, k in zip(parts, n, strict=True)])


def _dense(tile: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether there is a cell) as squares; repeated cells add up."""
    i, j, v = tile
    values, there = np.zeros((TILE, TILE), np.int64), np.zeros((TILE, TILE), np.float32)
    np.add.at(values, (i, j), v)
    there[i, j] = 1
    return values, there


def _whole_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers: as doubles where no sum leaves 53 bits, as 64-bit numbers where none leaves those, else exactly or an error."""
    bound = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) * TILE
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b if bound < 1 << 63 else (a.astype(object) @ b.astype(object)).astype(np.int64)


class _Right:
    """The right tiles of a place: their cells by rows, and the squares of those that were used last."""

    def __init__(self, tiles: dict[tuple[int, int], list[bytes]]) -> None:
        self.cells, self.columns, self.squares = {}, {}, {}
        for (k, j), parts in tiles.items():
            self.columns.setdefault(k, []).append(j)
            row, col, v = _cells_of(parts)
            order = np.argsort(row, kind="stable")
            self.cells[k, j] = row[order], col[order], v[order]

    def square(self, k: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (k, j) not in self.squares:
            if len(self.squares) >= 64:
                self.squares.clear()
            self.squares[k, j] = _dense(self.cells[k, j])
        return self.squares[k, j]


def _tile_product(left: tuple, squares: dict, right: _Right, k: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, v): products of two tiles, added up by cell if they are many; cell by cell if few. squares: left tiles of this row as squares, by k."""
    i, inner, v = left
    row, col, w = right.cells[k, j]
    begin = np.searchsorted(row, np.arange(TILE + 1))
    many = np.diff(begin)[inner]
    total = int(many.sum())
    if total >= TILE * TILE:
        if k not in squares:
            squares[k] = _dense(left)
        values, there = squares[k]
        found, at = _whole_product(values, right.square(k, j)[0]), np.nonzero(there @ right.square(k, j)[1])
        return *at, found[at]
    if not total:
        return i[:0], i[:0], v[:0]
    other = np.repeat(begin[inner] - (np.cumsum(many) - many), many) + np.arange(total)
    a, b = np.repeat(v, many), w[other]
    if max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) < 1 << 63:
        return np.repeat(i, many), col[other], a * b
    return np.repeat(i, many), col[other], (a.astype(object) * b.astype(object)).astype(np.int64)


def _product(left: dict, right_tiles: dict) -> Iterator[pa.RecordBatch]:
    """(i, j, v) for tiles of one place: {(row, inner): parts} times {(inner, column): parts}, a result tile at a time. A cell comes again where its sum might leave 64 bits."""
    right = _Right(right_tiles)
    rows: dict[int, list[int]] = {}
    for i, k in left:
        if k in right.columns:
            rows.setdefault(i, []).append(k)

    def shown(i: int, j: int, total: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
        r, c = np.nonzero(there)
        return pa.RecordBatch.from_arrays([pa.array(i * TILE + r), pa.array(j * TILE + c), pa.array(total[r, c])], names=["i", "j", "v"])

    for i, inner in rows.items():
        own = {k: _cells_of(left[i, k]) for k in inner}
        squares = {}
        for j in sorted({j for k in own for j in right.columns[k]}):
            total, there, reach = np.zeros((TILE, TILE), np.int64), np.zeros((TILE, TILE), bool), 0
            for k, cells in own.items():
                if (k, j) not in right.cells:
                    continue
                r, c, v = _tile_product(cells, squares, right, k, j)
                more = int(np.abs(v.astype(np.float64)).sum())
                if reach + more >= 1 << 62:
                    yield pa.RecordBatch.from_arrays([pa.array(i * TILE + r), pa.array(j * TILE + c), pa.array(v)], names=["i", "j", "v"])
                    continue
                np.add.at(total, (r, c), v)
                there[r, c] = True
                reach += more
            if there.any():
                yield shown(i, j, total, there)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The products of rows sorted by place."""
    place, sides = None, ({}, {})
    for b in batches:
        for *here, side, row, col, cells in zip(*(b.column(c).to_pylist() for c in ("gi", "gj", "gk", "side", "row", "col", "cells")), strict=True):
            if here != place:
                yield from _product(*sides)
                place, sides = here, ({}, {})
            sides[side].setdefault((row, col), []).append(cells)
    yield from _product(*sides)


def matrix_multiply_tiled(a: DataFrame, b: DataFrame, grid: Grid | None = None, place_cells: int = PLACE_CELLS) -> DataFrame:
    """matrix_multiply's cells, by tiles: one exchange of tiles, dealt to the grid, and one of the sums over the inner places.

    Each place multiplies its tiles as dense squares, and holds its own tiles and a few squares. A row or column of many cells, the hot inner
    index among them, is cut into tiles that lie at several places. The grid is measured (see grid_for) unless given. Indexes are whole
    numbers from 0; rows with a null are ignored.
    """
    plain = [m.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("long").alias("v")).dropna() for m in (a, b)]
    if grid is None:
        sizes = [m.agg(F.count("*").alias("n"), F.max("i").alias("i"), F.max("j").alias("j")).first() for m in plain]
        along = lambda top: (top or 0) // TILE + 1
        grid = grid_for(sizes[0]["n"], sizes[1]["n"], along(sizes[0]["i"]), along(sizes[1]["j"]), along(max(sizes[0]["j"] or 0, sizes[1]["i"] or 0)), place_cells, tasks=a.sparkSession.sparkContext.defaultParallelism)
    left, right = (m.mapInArrow(_tiles, "row long, col long, cells binary") for m in plain)
    turn = lambda name, n: F.pmod(name, F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = left.select(turn("row", grid.rows).alias("gi"), each(grid.columns).alias("gj"), turn("col", grid.inner).alias("gk"), F.lit(0).alias("side"), "row", "col", "cells")
    met = right.select(each(grid.rows).alias("gi"), turn("col", grid.columns).alias("gj"), turn("row", grid.inner).alias("gk"), F.lit(1).alias("side"), "row", "col", "cells")
    place = ["gi", "gj", "gk"]
    number = (F.col("gi") * grid.columns + F.col("gj")) * grid.inner + F.col("gk")
    places = min(grid.rows * grid.columns * grid.inner, MOST_PLACES)
    dealt = sent.unionByName(met).repartitionById(places, F.pmod(number, F.lit(places)).cast("int")).sortWithinPartitions(*place)
    return dealt.mapInArrow(_products, "i long, j long, v long").groupBy("i", "j").agg(F.sum("v").alias("v"))


#: Tasks at most to which the places of a grid are dealt.
MOST_PLACES = 20_000
