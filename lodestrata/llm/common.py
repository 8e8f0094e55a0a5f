"""Tables kept between jobs, and other helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS_IN_BATCH, BYTES_IN_BATCH = 1000, "4m"  #: of Arrow data between Spark and Python while a table is written, at most (a longer row is a batch)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, giving memory back to the system at a task's end: Python workers are used again and would else keep their peak."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # of glibc
            ctypes.CDLL(None).malloc_trim(0)

    return inner


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; any other master is an error, as its
    executors would not see that folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lodestrata_root", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = sc._lodestrata_root = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return root.rstrip("/")


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k, None) for k in (rows, size)}
    most = int(before[rows] or 0)
    spark.conf.set(rows, str(min(most, ROWS_IN_BATCH) if most > 0 else ROWS_IN_BATCH))  # texts, and sets of words, may be long
    spark.conf.set(size, BYTES_IN_BATCH)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*kept: DataFrame) -> None:
    """Delete tables of keep() that no later plan reads."""
    for df in kept:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_join(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi", most: int = 2_000_000, size: int | None = None) -> DataFrame:
    """Join df with a kept table of ids: broadcast where it counts at most ``most`` rows, shuffled beyond.

    ``size``: what counts instead, where rows hold lists.
    """
    return df.join(F.broadcast(ids) if (ids.count() if size is None else size) <= most else ids, key, how)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
