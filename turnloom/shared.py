"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a folder of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="turnloom-")
    return _OWN[context.applicationId]


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table of the shared folder: computed once, whatever reads it, and there after a lost executor."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def walked(start: DataFrame, step: Callable[[DataFrame], DataFrame], depth: int, label: str) -> DataFrame:
    """The rows of start, of a step from them, of a step from those and so on until one has none, as a table of the shared folder.

    A level is a job over the rows of the level before, however many they are (Spark's recursive queries end at a million). More
    than `depth` levels are an error, never cut.
    """
    spark, names = start.sparkSession, start.columns
    path, n, level = f"{folder(spark)}/{label}-{uuid.uuid4().hex}", 0, start
    while True:
        level.select(*names).write.parquet(f"{path}/level={n}")
        level = spark.read.schema(start.schema).parquet(f"{path}/level={n}")
        if level.isEmpty():
            return spark.read.schema(start.schema).parquet(path).select(*names)
        if n > depth:
            raise ValueError(f"RECURSION_LEVEL_LIMIT: there are more than {depth} levels")
        level, n = step(level), n + 1
