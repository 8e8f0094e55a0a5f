"""Tables of one row for each key, the latest: upserts rewrite only the hash buckets that a batch touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.kept import discard, keep


@dataclass(frozen=True)
class KeyedTable:
    """Parquet under ``path``, in folders by a hash of the keys. ``order`` names the columns by which a row is later than another.

    ``buckets`` can't change once the table has rows. Between rows that are equally late, the one with the greater other values stays,
    so that the table is the same whatever way the rows came, and again when a batch comes twice. Rows with a null key are none.
    """

    path: str
    schema: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def columns(self) -> list[str]:
        return T._parse_datatype_string(self.schema).names

    def exists(self, spark: SparkSession) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows; an empty table if nothing was written."""
        if not self.exists(spark):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(f"{self.schema}, bucket int").parquet(self.path).select(self.columns())

    def lookup(self, asked: DataFrame) -> DataFrame:
        """Rows of the asked keys: buckets without any are not opened."""
        spark = asked.sparkSession
        if not self.exists(spark):
            return spark.createDataFrame([], self.schema)
        at = [r.b for r in asked.select(self.bucket().alias("b")).distinct().collect()]  # numbers of buckets
        rows = spark.read.schema(f"{self.schema}, bucket int").parquet(self.path).where(F.col("bucket").isin(at))
        return rows.select(self.columns()).join(asked.select(*self.keys).distinct(), list(self.keys), "left_semi")

    def latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns() if c not in self.keys and c not in self.order]
        top = F.max(F.struct(*self.order, *rest)).alias("top")
        return rows.dropna(subset=list(self.keys)).groupBy(*self.keys).agg(top).select(*self.keys, "top.*").select(self.columns())

    def upsert(self, batch: DataFrame) -> None:
        """Put the rows of a batch in: those with new keys, and those that are later than what is there.

        What the touched buckets will hold is written aside first, then put in their place, bucket by bucket. A batch
        that failed on the way is run again.
        """
        spark = batch.sparkSession
        new = keep(self.latest(batch.select(self.columns())).withColumn("bucket", self.bucket()), "batch")
        at = [r.bucket for r in new.select("bucket").distinct().collect()]
        old = spark.createDataFrame([], self.schema)
        if self.exists(spark):
            old = spark.read.schema(f"{self.schema}, bucket int").parquet(self.path).where(F.col("bucket").isin(at)).select(self.columns())
        rows = keep(self.latest(old.unionByName(new.select(self.columns()))).withColumn("bucket", self.bucket()), "upsert")
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        discard(new, rows)
