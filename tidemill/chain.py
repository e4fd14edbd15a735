"""Chains of stages that go on where they stopped.

Each stage's table is written to a folder named by the stage and a fingerprint: of its name, version and parameters, and of what it
reads, files by path, size and time, earlier stages by their fingerprint. A marker beside the table says that it is whole. A
rerun reads what has a marker under the same fingerprint, and begins with the first stage that has none; if an input or a
parameter changes, so do the fingerprints from there on.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """function(spark, *tables, **parameters) gives the stage's table; reads: names of earlier stages or of inputs. Raise version when the function changes."""

    name: str
    function: Callable[..., DataFrame]
    reads: Sequence[str]
    parameters: dict = field(default_factory=dict)
    version: int = 1


def _path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, path: str) -> list[list]:
    """[path, bytes, time] of the files under path, in order."""
    at, fs = _path(spark, path)
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        status = files.next()
        found.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
    return sorted(found)


def _digest(what) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()[:24]


def _marked(spark: SparkSession, folder: str) -> bool:
    at, fs = _path(spark, f"{folder}/whole")
    return fs.exists(at)


def run_chain(spark: SparkSession, folder: str, inputs: dict[str, str], stages: Sequence[Stage], progress: Callable[[str, bool], None] | None = None) -> DataFrame:
    """The last stage's table. inputs: Parquet tables by name.

    Intermediate tables stay in folder, which driver and executors must share. progress is called with each stage's name and
    whether its table was there. A stage that fails leaves no marker; what it wrote is replaced by the next run.
    """
    tables = {name: spark.read.parquet(path) for name, path in inputs.items()}
    prints = {name: _digest(_files(spark, path)) for name, path in inputs.items()}
    for stage in stages:
        if stage.name in tables:
            raise ValueError(f"two tables are called {stage.name!r}")
        prints[stage.name] = _digest([stage.name, stage.version, stage.parameters, [prints[r] for r in stage.reads]])
        own = f"{folder}/{stage.name}-{prints[stage.name]}"
        there = _marked(spark, own)
        if not there:
            stage.function(spark, *(tables[r] for r in stage.reads), **stage.parameters).write.mode("overwrite").parquet(f"{own}/table")
            at, fs = _path(spark, f"{own}/whole")
            fs.create(at, True).close()
        if progress:
            progress(stage.name, there)
        tables[stage.name] = spark.read.parquet(f"{own}/table")
    return tables[stages[-1].name]
