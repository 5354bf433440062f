import os
import shutil
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gossamer.llm import _store

TOP = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
JOIN = """
from pyspark.sql import SparkSession
import gossamer
from gossamer.llm import jaccard
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", SHARED).getOrCreate()
gossamer.ship(spark)
rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(40)) + " end" * (i % 2)) for i in range(20)]
out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5).collect()
assert all(r.component_id == r.doc_id - r.doc_id % 2 and r.n_links == 1 for r in out) and len(out) == 20
"""


def test_the_join_starts_no_process_for_its_files(tmp_path):
    """A process that the executor's JVM starts holds all its memory until it is another program."""
    calls, shared = tmp_path / "calls", tmp_path / "shared"
    (tmp_path / "bin").mkdir()
    shim = tmp_path / "bin" / "chmod"
    shim.write_text(f'#!/bin/sh\necho "$@" >> {calls}\nexec {shutil.which("chmod")} "$@"\n')
    shim.chmod(0o755)
    env = os.environ | {"PATH": f"{tmp_path / 'bin'}:{os.environ['PATH']}", "PYTHONPATH": TOP}
    done = subprocess.run([sys.executable, "-c", JOIN.replace("SHARED", repr(f"file://{shared}"))], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert any((shared / "gossamer").iterdir())
    found = calls.read_text().splitlines() if calls.exists() else []
    assert [x for x in found if str(shared / "gossamer") in x] == []


def test_a_table_holds_each_row_once(spark, monkeypatch):
    monkeypatch.setattr(_store, "ROW_GROUP", 64)
    df = spark.range(0, 500, 1, 5).select("id", F.array(F.col("id"), F.lit(None)).alias("both"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string").cast("binary")).alias("b"))
    out = _store.mapped_table(df, "rows")
    assert out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    folder = _store._local(spark, out._gossamer_path)
    assert len(os.listdir(folder)) == 5 and "_tries" not in os.listdir(folder)
    _store.forget(out, spark)
    assert not os.path.exists(folder)


def test_a_table_of_no_rows_and_of_a_function(spark):
    assert _store.mapped_table(spark.range(0).select("id"), "none").collect() == []

    def twice(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(0)], names=["b", "a"])  # found by name

    out = _store.mapped_table(spark.range(0, 9, 1, 3).where("id != 4"), "twice", twice, "a long, b long")
    assert sorted(tuple(r) for r in out.collect()) == [(i, i) for i in range(9) if i != 4]


def test_a_failed_table_leaves_nothing(spark):
    def fails(batches):
        for b in batches:
            yield b
            raise ValueError("no more")

    root = f"{_store.shared_root(spark)}/gossamer"
    with pytest.raises(Exception, match="no more"):
        _store.mapped_table(spark.range(9), "failed", fails, "id long")
    assert not [x for x in os.listdir(root) if x.startswith("failed")]
