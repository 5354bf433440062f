"""Closures kept up to date while quads arrive.

Each micro-batch is the delta of a semi-naive run: only what needs a new quad is derived. The closure is a folder of
Parquet parts, one for each batch; a batch that is run again after a failure replaces its part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from gossamer.plans import rules as R


class Closure:
    """The fixpoint of rules over a stream of quads, in a folder."""

    def __init__(self, spark: SparkSession, folder: str, rules: list[R.Rule], most_rounds: int = 1000):
        self.spark, self.folder, self.rules, self.most_rounds = spark, folder, rules, most_rounds

    def parts(self, before: int | None = None) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
        done = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(n + "/_SUCCESS"))]
        return sorted(n for n in done if before is None or int(n.rpartition("=")[2]) < before)

    def quads(self, before: int | None = None) -> DataFrame:
        parts = self.parts(before)
        return self.spark.read.schema(R.QUADS).parquet(*parts) if parts else R.empty(self.spark)

    def take(self, batch: DataFrame, number: int) -> None:
        """Adds a batch and all that follows from it."""
        known = self.quads(number)
        delta = batch.select("g", "s", "p", "o").distinct().join(known, ["g", "s", "p", "o"], "left_anti")
        new = R.think_delta(known, delta, self.rules, most_rounds=self.most_rounds)
        new.write.mode("overwrite").parquet(f"{self.folder}/batch={number:08d}")

    def follow(self, stream: DataFrame, checkpoint: str, trigger: Callable | None = None) -> StreamingQuery:
        """A query that takes every micro-batch of a stream of quads."""
        writer = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return (trigger(writer) if trigger else writer.trigger(availableNow=True)).start()
