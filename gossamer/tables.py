"""Intermediate tables in the folder that driver and executors share (`spark.checkpoint.dir`; a temporary one of this
process where that is unset). Writing a table cuts the lineage and survives the loss of executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="gossamer-tables-"))
        root = _own[0]
    return f"{root.rstrip('/')}/gossamer/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of steps that are over, a collection of garbage ahead of its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
