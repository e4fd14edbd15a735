"""Top-k rows by a measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(rows: DataFrame, k: int = 3, by: str = "salary", tie: str = "id") -> DataFrame:
    """The k rows with the largest `by`, ties to the smallest `tie`; repeated rows count as often as they occur.

    Planned as a local top-k in each task and one merge of k rows a task; nothing is sorted as a whole.
    """
    return rows.orderBy(F.desc(by), F.asc(tie)).limit(k)


def top_k_distinct(rows: DataFrame, k: int = 3, by: str = "salary", tie: str = "id") -> DataFrame:
    """top_k over the distinct rows."""
    return top_k(rows.distinct(), k, by, tie)
