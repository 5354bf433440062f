"""The folder that driver and executors share, and tables and files written to it.

Everything that outlives one task goes through here: `spark.checkpoint.dir` names the folder, Spark's own writers
or the Python workers make the tables, and `pyarrow.fs` the files (a temporary name first, then a rename, so that a
repeated task leaves one whole file).
"""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_own: list[str] = []
#: Bytes of rows that a worker gathers for one row group of a table.
ROW_GROUP = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one of this process where the setting is unset in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gossamer-shared-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/gossamer/{name}-{uuid.uuid4().hex[:12]}"


def free(spark: SparkSession) -> None:
    """Delete what finished queries have shuffled: it is unreachable, and Spark deletes it when the driver's Python and
    then its JVM collect garbage, which by itself may be half an hour away."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    free(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gossamer_path = path
    return out


def _local(spark: SparkSession, path: str) -> str | None:
    """The path for Python where Spark's file system of it is the local (mounted) one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def mapped_table(df: DataFrame, name: str, f=None, schema: str | None = None) -> DataFrame:
    """What `written` gives of df, or of df.mapInArrow(f, schema), with other hands: in a mounted shared folder the
    Python workers write the files, in the same pass as f.

    For each folder and file that Spark's writer makes in a local file system, Hadoop starts a `chmod` from the
    executor's JVM, and until it is one, that process has all of the JVM's memory, counted a second time by whoever
    limits an executor with its children. A task writes under `_tries`; the driver moves the files of the tasks that
    Spark counts as done, so that repeated tasks add nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    folder = _local(spark, path)
    if folder is None:
        return written(df.mapInArrow(f, schema) if f else df, name)
    kind = T.StructType.fromDDL(schema) if schema else df.schema
    columns = to_arrow_schema(kind)
    tries = f"{folder}/_tries"
    os.makedirs(tries)

    def run(batches):
        file = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.parquet"
        writer, held, size = None, [], 0
        try:
            for batch in f(batches) if f else batches:
                if not batch.num_rows:
                    continue
                held.append(batch.select(columns.names).cast(columns))
                size += batch.nbytes
                if size >= ROW_GROUP:
                    writer = writer or pq.ParquetWriter(f"{tries}/{file}", columns)
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                writer = writer or pq.ParquetWriter(f"{tries}/{file}", columns)
                writer.write_table(pa.Table.from_batches(held))
        finally:
            if writer:
                writer.close()
        yield pa.RecordBatch.from_pydict({"file": [file] if writer else []}, pa.schema([("file", pa.string())]))

    try:
        for r in df.mapInArrow(run, "file string").collect():  # a row a task
            os.rename(f"{tries}/{r.file}", f"{folder}/{r.file}")
    except BaseException:
        shutil.rmtree(folder, ignore_errors=True)
        raise
    shutil.rmtree(tries, ignore_errors=True)
    free(spark)
    out = spark.read.schema(kind).parquet(path)
    out._gossamer_path = path
    return out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def put(uri: str, content: bytes) -> None:
    """Write a file whole or not at all; the same content again leaves the same file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, path)


def get(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        if length is None and not offset:
            return f.read()
        f.seek(offset)
        return f.read(length)


def mounted(uri: str) -> bool:
    return isinstance(filesystem(uri)[0], pafs.LocalFileSystem)


def mapped(uri: str):
    """A buffer over the file: memory-mapped where the shared folder is mounted, read once elsewhere."""
    import pyarrow as pa

    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def remove(df_or_path: str, spark: SparkSession) -> None:
    """Delete a file or folder of the shared folder, through Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df_or_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame, spark: SparkSession) -> None:
    """Delete the table in the shared folder that `written` gave."""
    remove(df._gossamer_path, spark)
