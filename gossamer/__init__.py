"""A rule, graph-query and policy engine on Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()
#: Bytes of rows that one Arrow batch holds, unless the session says otherwise.
BATCH = 4 << 20


def ship(spark) -> None:
    """Send this package to the Python workers of the session's executors, once for each application. Not needed where
    it is installed there, harmless then. Bounds Arrow batches by `BATCH` where the session has Spark's own bound, so
    that a run of long texts fills neither a worker nor the memory beside the executor's heap."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) in (None, "67108864b", "64m", "64MB"):
        spark.conf.set(size, str(BATCH))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="gossamer-"), "gossamer.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
