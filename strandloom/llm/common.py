"""What the operators of this subpackage share: the shared work folder, file access and input cleaning."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from functools import partial
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes in one Arrow batch between the JVM and Python; a batch ends at whichever comes first.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20
#: Work folders that shared_dir has named in this process.
_made: list[str] = []
#: The operator that keeps something in this worker between tasks, and what forgets it.
_keeper: list = ["", None]


def prepare(spark: SparkSession) -> None:
    """Lets local Python workers import this package and bounds Arrow batches. On a cluster the package is shipped with --py-files.

    Frames of the operators are lazy, so the bounds stay in the session's settings; a smaller one that is set already holds.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "1"), ("MALLOC_MMAP_THRESHOLD_", "1048576"), ("MALLOC_TRIM_THRESHOLD_", "1048576"), ("OPENBLAS_NUM_THREADS", "1")):
        env.setdefault(name, value)  # a worker gives freed memory back, and has one thread for its one task
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def only(name: str = "", forget=None) -> None:
    """A task of an operator begins in this worker: what those of another have kept here between their tasks is forgotten.

    Workers outlive stages, and a pipeline's caches would add up in them. forget: drops what tasks of this name keep.
    """
    if _keeper[0] not in ("", name):
        _keeper[1]()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass
    _keeper[:] = name, forget


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir, which the driver and all executors see.

    Where the setting is absent (tests, a local session) a temporary folder of this machine takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        got = spark.sparkContext.getCheckpointDir()
        if got is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            got = Path(tempfile.mkdtemp(prefix="strandloom-")).as_uri()
            spark.sparkContext.setCheckpointDir(got)
            got = spark.sparkContext.getCheckpointDir() or got
        base = got
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def clear(spark: SparkSession) -> int:
    """Deletes all work folders of this process, once no frame of an operator is needed any more; returns their number."""
    n = len(_made)
    while _made:
        remove(spark, _made.pop())
    return n


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, stored, with a number of their own in a column whose name no other column has, and that name."""
    number = "row_number_of_copy"
    while number.lower() in map(str.lower, docs.columns):
        number += "_"
    return stored(docs.withColumn(number, F.monotonically_increasing_id()), name), number


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def _picked(batches, number, folder, keep, then):
    only()
    rows = _listed(batches, number, folder, keep)
    yield from rows if then is None else then(rows)


def _listed(batches, number, folder, keep):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = file_system(folder)
    part, listed = None, np.zeros(0, np.int64)
    for b in batches:
        rows = b.column(b.schema.get_field_index(number)).to_numpy()
        hit = np.zeros(len(rows), bool)
        for p in np.unique(rows >> 33).tolist():
            if p != part:
                names = store.get_file_info(fs.FileSelector(f"{path}/part={p}", allow_not_found=True))
                files = [f.path for f in names if f.path.endswith(".parquet")]
                part, listed = p, np.concatenate([np.zeros(0, np.int64), *(pq.read_table(f, columns=["listed"], filesystem=store, partitioning=None)["listed"].to_numpy() for f in files)])
            hit |= np.isin(rows, listed)
        yield b.filter(pa.array(hit == keep, pa.bool_()))


def picked(docs: DataFrame, number: str, listed: DataFrame, keep: bool = True, then=None, schema: str | None = None) -> DataFrame:
    """The rows of a numbered table that a list of numbers (its only column) names, or all others.

    The list is cut by the partition that wrote a row (the number's upper bits), and a task over a file of the table reads
    the part for that file: the wide rows of the table never cross a shuffle, whatever the length of the list.
    then: what to make of the batches of these rows in the same worker, to rows of `schema`.
    """
    folder = shared_dir(docs.sparkSession, "picked")
    listed = listed.select(F.col(listed.columns[0]).alias("listed"), F.shiftright(listed.columns[0], 33).alias("part"))
    listed.repartition("part").write.partitionBy("part").parquet(folder)
    return docs.mapInArrow(partial(_picked, number=number, folder=folder, keep=keep, then=then), schema or docs.schema)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_system(uri: str):
    """pyarrow file system and path of a URI; works on executors without a JVM."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, parts) -> int:
    """Writes a whole file under a name of this attempt and then moves it into place: a retried or doubled task leaves one whole file."""
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    temp, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with store.open_output_stream(temp) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    store.move(temp, path)
    return size


def read_range(uri: str, start: int, length: int) -> bytes:
    store, path = file_system(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)


def read_bytes(uri: str) -> bytes:
    store, path = file_system(uri)
    with store.open_input_file(path) as f:
        return f.read()


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
