"""The given tables as collections of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_of(docs: DataFrame) -> DataFrame:
    """Non-blank lines: node_id (doc_id:line), doc_id, ord, filename, lang, file_hash of the whole text, text."""
    d = docs.select("doc_id", "lang", F.col("source").alias("filename"), F.sha2("text", 256).alias("file_hash"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    return d.where(F.col("text").rlike(r"\S")).select(F.concat_ws(":", "doc_id", "ord").alias("node_id"), "doc_id", "ord", "filename", "lang", "file_hash", "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(table(spark, sf_dir, "documents"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as findings: toxic is the flag, quality the confidence."""
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("flag"), F.lit("toxicity").alias("category"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("confidence"))
