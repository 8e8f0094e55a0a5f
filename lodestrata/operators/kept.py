"""Tables kept in the shared folder between jobs: lineage ends there, and a lost executor costs nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local master without one gets a temporary folder, any other is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lodestrata_root", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = sc._lodestrata_root = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{root(spark)}/{tag}-{uuid.uuid4().hex}"


def keep(df: DataFrame, tag: str = "kept", by: str | None = None) -> DataFrame:
    """Write df, in folders by the values of a column if one is named, and read it back."""
    path, writer = new_path(df.sparkSession, tag), df.write
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*kept: DataFrame) -> None:
    """Delete tables of keep() that no later plan reads."""
    for df in kept:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
