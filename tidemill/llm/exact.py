"""Whole numbers of any size in Spark: summed on the executors as limbs, put together again on the driver.

A number is the sum of its limbs times powers of 2**32; all limbs but the last lie in 0..2**32 - 1. Limbs are
added up as long, so up to 2**31 partial sums never overflow, whatever the size of the numbers.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 32
#: What `limbs` gives, a row a limb: the number's place in a list, the limb's place, the limb.
SCHEMA = "at long, limb int, value long"


def limbs(numbers: Iterable[int]) -> pa.RecordBatch:
    """Rows (at, limb, value) of a list of numbers; zeros have none."""
    at, place, value = [], [], []
    for k, v in enumerate(numbers):
        j, v = 0, int(v)
        while v:
            last = -(1 << LIMB - 1) <= v < 1 << LIMB - 1
            at.append(k)
            place.append(j)
            value.append(v if last else v & (1 << LIMB) - 1)
            v, j = (0 if last else v >> LIMB), j + 1
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(place, pa.int32()), pa.array(value, pa.int64())], names=["at", "limb", "value"])


def summed(parts: DataFrame, size: int) -> list[int]:
    """The list of `size` sums of all lists in parts (rows as of `limbs`). The driver receives a few rows a number."""
    out = [0] * size
    for r in parts.groupBy("at", "limb").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] += r["value"] << LIMB * r["limb"]
    return out


def as_long(v: int) -> int | None:
    """v where a 64-bit number holds it, else None."""
    return v if -(1 << 63) <= v < 1 << 63 else None


def usable(vector: str) -> Column:
    """Whether the column of arrays is not null and holds finite numbers only."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls as doubles; shorter ones are filled up with 0."""
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out
