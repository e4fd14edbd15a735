"""What the operators of this subpackage share of the session: the folder of the cluster and the width of a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.folders import cut, forget, new_folder, settled, shared_dir, tidy

__all__ = ["cut", "forget", "new_folder", "partitions", "read_alike", "settled", "shared_dir", "tidy"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Nodes of an optimised plan whose rows come in one order whenever they are read, if their expressions have one value only.
_PLAIN = {"LogicalRelation", "Relation", "LocalRelation", "Project", "Filter"}


def read_alike(df: DataFrame) -> DataFrame:
    """df, if it is a plain scan of files with projections and filters; else df written once, so that each read gives the same rows in the same tasks and order."""

    def plain(node) -> bool:
        children = node.children()
        known = node.nodeName().split(" ")[0] in _PLAIN or node.getClass().getSimpleName() in _PLAIN
        return known and all(plain(children.apply(k)) for k in range(children.size()))

    plan = df._jdf.queryExecution().optimizedPlan()
    return df if plan.deterministic() and plain(plan) else cut(df)
