"""Embedding whitening from an exact integer scatter.

Entries become whole numbers x = floor(SCALE * c) + OFFSET. A shift, the numbers of any one row, is subtracted, so that
what is multiplied is small. Each task adds up its shifted rows and their cross-products without rounding: rows are cut
into digits of DIGIT bits, whose products and sums fit a double exactly, and the results are Python integers, which
travel as limbs (see exact.py) and are summed by Spark. So n * XtX - S * St is formed exactly, whatever the order of
rows and the common offset of the entries; only then it becomes double, correctly rounded, and is decomposed by eigh.

The driver receives d * (d + 3) / 2 + 1 sums for d dimensions (MAX_WIDTH at most, else an error), whatever the number of rows.

Null vectors and those with null or non-finite entries are left out. Vectors shorter than the longest one are filled up
with zeros, an empty one wholly. Repeated rows and ids count as often as they come; null ids are kept; extra columns are
ignored, whatever their names. An empty table gives no rows. Entries beyond +-2**61 (after scaling) count as that bound.
A component whose variance is 0 but for rounding (copies of one vector only, fewer rows than components) has null
`whitened`; if all are, explained and identity_error are null. A deviation beyond 64 bits is null, and right in
`deviation_digits`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import exact

SCALE, OFFSET = 64, 1_000_000
#: Components returned, and most dimensions.
COMPONENTS, MAX_WIDTH = 32, 4096
#: Bits of a digit, and rows multiplied at once: products of two digits, summed over the rows, stay below 2**53.
DIGIT, ROWS = 20, 4096
#: Bits of the lower part of a deviation: sums of products of two parts over MAX_WIDTH dimensions fit 64 bits.
HALF = 25
_BOUND = float(1 << 61)


def whole(values: np.ndarray) -> np.ndarray:
    """x - OFFSET of entries as int64."""
    return np.clip(np.floor(SCALE * values), -_BOUND, _BOUND).astype(np.int64)


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """y as digits of DIGIT bits, lowest first, the last one signed; doubles."""
    out = []
    while True:
        if not y.size or max(abs(int(y.min())), abs(int(y.max()))) < 1 << DIGIT:
            return [*out, y.astype(np.float64)]
        out.append((y & (1 << DIGIT) - 1).astype(np.float64))
        y = y >> DIGIT


def block_scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of at most ROWS rows of int64, as arrays of Python integers."""
    digits = _digits(y)
    width = y.shape[1]
    sums, cross = np.zeros(width, object), np.zeros((width, width), object)
    for a, left in enumerate(digits):
        sums += left.sum(axis=0).astype(np.int64).astype(object) << DIGIT * a
        for b, right in enumerate(digits):
            cross += (left.T @ right).astype(np.int64).astype(object) << DIGIT * (a + b)
    return sums, cross


@dataclass
class Scatter:
    """n rows, the shift, and sums and cross-products of the shifted rows, exactly."""

    n: int
    shift: np.ndarray
    sums: np.ndarray
    cross: np.ndarray

    def numerators(self) -> np.ndarray:
        """n * XtX - S * St, which the shift leaves as it is; the covariance is this by n * n."""
        return self.n * self.cross - np.outer(self.sums, self.sums)


def scatter(vectors: DataFrame, vector: str = "embedding") -> Scatter | None:
    """The scatter of usable vectors; None without any."""
    rows = vectors.select(F.col(vector).alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return None
    if width > MAX_WIDTH:
        raise ValueError(f"a vector of {width} components; the scatter of more than {MAX_WIDTH} does not go through the driver")
    some = rows.first()["v"]
    shift = whole(np.array([*some, *[0.0] * (width - len(some))], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(width, object), np.zeros((width, width), object)
        step = max(1, min(ROWS, (1 << 21) // max(width, 1)))
        for b in batches:
            for at in range(0, b.num_rows, step):
                y = whole(exact.matrix(b.column(0).slice(at, step), width)) - shift
                s, c = block_scatter(y)
                n, sums, cross = n + len(y), sums + s, cross + c
        yield exact.limbs([n, *sums, *cross[np.triu_indices(width)]])

    upper = np.triu_indices(width)
    n, *found = exact.summed(rows.mapInArrow(run, exact.SCHEMA), 1 + width + len(upper[0]))
    cross = np.zeros((width, width), object)
    cross[upper] = found[width:]
    cross[upper[1], upper[0]] = found[width:]
    return Scatter(n, shift, np.array(found[:width], object), cross)


@dataclass
class Whitener:
    """What a row needs: n, shift and shifted sums, unit components (a column each) by falling eigenvalue, and their share of the trace."""

    n: int
    shift: np.ndarray
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: list[float | None]

    def deviations(self, y: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(n * x - S as doubles, each rounded once; the exact sum of its squares for each row) for shifted rows."""
        top = max((abs(int(v)) for v in (y.min(), y.max())), default=0) if y.size else 0
        if self.n * top + max((abs(s) for s in self.sums), default=0) < 1 << 61:
            d = y * self.n - np.array(self.sums, np.int64)
            low, high = (d & (1 << HALF) - 1), d >> HALF
            if abs(high).max(initial=0) < 1 << HALF:
                parts = [(p * q).sum(axis=1) for p, q in ((low, low), (low, high), (high, high))]
                return d.astype(np.float64), [a + (b << HALF + 1) + (c << 2 * HALF) for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]
        d = y.astype(object) * self.n - self.sums
        return d.astype(np.float64), [int(v) for v in (d * d).sum(axis=1)] if d.shape[1] else [0] * len(d)

    def whitened(self, far: np.ndarray) -> np.ndarray:
        """Components of rows of n * x - S, divided by the square root of their eigenvalue; not a number where that is 0."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (far / self.n) @ self.components / np.sqrt(self.values), np.nan)


def decompose(found: Scatter, components: int = COMPONENTS) -> Whitener:
    numerators, square = found.numerators(), found.n * found.n
    width = len(numerators)
    covariance = np.array([[v / square for v in row] for row in numerators.tolist()], np.float64).reshape(width, width)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    # Signs are free: the largest entry is positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0) if width else vectors
    values = np.where(values > width * np.finfo(float).eps * values.max(initial=0), values, 0.0)
    trace = sum(numerators[k, k] for k in range(width)) / square
    return Whitener(found.n, found.shift, found.sums, vectors, values, [float(v / trace) if trace else None for v in values])


def identity_error(vectors: DataFrame, fitted: Whitener, vector: str = "embedding") -> float | None:
    """Largest entry of the whitened rows' own covariance minus the identity, over the components of some variance; None without any."""
    width, use = len(fitted.shift), np.flatnonzero(fitted.values > 0)
    if not len(use):
        return None
    upper = np.triu_indices(len(use))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, cross = np.zeros(len(use)), np.zeros((len(use),) * 2)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                y = whole(exact.matrix(b.column(0).slice(at, ROWS), width)) - fitted.shift
                w = fitted.whitened(fitted.deviations(y)[0])[:, use]
                sums += w.sum(axis=0)
                cross += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(use) + len(upper[0]))), pa.array(np.concatenate([sums, cross[upper]]))], names=["at", "v"])

    parts = vectors.select(F.col(vector).alias("v")).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    total = np.zeros(len(use) + len(upper[0]))
    for r in parts.collect():
        total[r["at"]] = r["v"]
    mean, cross = total[: len(use)] / fitted.n, total[len(use) :] / fitted.n
    return float(np.abs(cross - mean[upper[0]] * mean[upper[1]] - (upper[0] == upper[1])).max())


def whiten(docs: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation long, deviation_digits, whitened array<double>, explained array<double>, identity_error): one row for each usable vector."""
    rows = docs.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where(exact.usable("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, n long, deviation long, deviation_digits string, whitened array<double>, explained array<double>, identity_error double"
    found = scatter(rows, "v")
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    fitted = decompose(found, components)
    error = identity_error(rows, fitted, "v")
    width, shown = len(fitted.shift), len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                far, squares = fitted.deviations(whole(exact.matrix(part.column(1), width)) - fitted.shift)
                n = part.num_rows
                lists = lambda flat, size: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), flat)
                flat = fitted.whitened(far).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([found.n] * n, pa.int64()), pa.array([exact.as_long(v) for v in squares], pa.int64()), pa.array([str(v) for v in squares], pa.string()),
                        lists(pa.array(flat, pa.float64(), mask=np.isnan(flat)), shown), lists(pa.array(fitted.explained * n, pa.float64()), shown), pa.array([error] * n, pa.float64()),
                    ],
                    names=["vec_id", "n", "deviation", "deviation_digits", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)


def by_component(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    each = whitened.withColumn("z", F.arrays_zip("whitened", "explained")).select("vec_id", F.posexplode("z").alias("k", "z"), "n", "deviation", "deviation_digits", "identity_error")
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("z.whitened").alias("whitened"), F.col("z.explained").alias("explained"), "identity_error", "deviation_digits")
