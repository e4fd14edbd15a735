"""Sizes that plans depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Estimated bytes up to which an input is dealt over all cores before work on it: one file of one row group is one task otherwise.
SPREAD_BELOW = 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan; Long.MAX where nothing is known."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, below: int = SPREAD_BELOW) -> DataFrame:
    """df, dealt evenly over the cores if it is small; a large input has row groups enough and is not moved."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if estimated_bytes(df) <= below else df


#: Estimated bytes of texts for which an exchange makes one partition, so that what a task explodes and sorts doesn't grow with the input.
PART_BYTES = 4 << 20
#: Estimates beyond this are no estimates: products of joins, or nothing known.
_KNOWN = 1 << 50


def parts_of(df: DataFrame, each: int | None = None) -> int:
    """Partitions for an exchange of df: one for each estimated `each` (PART_BYTES) bytes, one a core at least; the session's number where the size is not known.

    A number given to repartition is kept; without one, adaptive execution merges partitions by their compressed bytes, of which a
    task makes many times as many rows.
    """
    size, spark = estimated_bytes(df), df.sparkSession
    if size > _KNOWN:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, -(-size // (each or PART_BYTES)))
