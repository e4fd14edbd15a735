"""The folder that driver and executors share, and what is written there."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests); a cluster must name one.

    Spark removes checkpoints that are no longer used if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None:
            if not re.match(r"local($|\[)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tidemill-checkpoints-")
        context.setCheckpointDir(named)
    return named or os.path.dirname(context.getCheckpointDir())


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of our own in the shared one, not yet there."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, *folders: str) -> None:
    """Empties folders that were written: what replaces their files is a table without rows."""
    for folder in folders:
        spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(folder)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle and checkpoint files that nothing refers to any more. It does so when the driver collects garbage, which a driver with little to do on its own heap puts off while the executors' disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: its rows survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, *folders: str) -> DataFrame:
    """df cut, so that the folders that it was read from can be emptied."""
    done = cut(df)
    forget(df.sparkSession, *folders)
    return done
