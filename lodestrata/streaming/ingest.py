"""Incremental ingest as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..operators import plugs
from ..operators.kept import discard, keep
from ..plans.adapters import chunks_of
from ..sources.keyed import KeyedTable


def stream_documents(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and values of every hour and type; an hour is final once the watermark has passed it."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


MANIFEST = "collection string, file_hash string, status string, started_at timestamp, updated_at timestamp, error string, batch long"


def manifest_table(path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(path, MANIFEST, ("collection", "file_hash"), ("updated_at", "status"), buckets)


def ingest(stream: DataFrame, chunks_path: str, manifest_path: str, checkpoint: str, collection: str = "default", enrich: plugs.Plug | None = None) -> StreamingQuery:
    """Chunks of new texts, batch by batch, and the state of each text in the manifest.

    A text is known by its hash: of equal ones in a batch the one with the least doc_id is taken, and those that the manifest has as
    completed by another batch are left out, so that no state grows with the stream. A batch marks its texts as started, writes their
    chunks into a folder of its number (again, if it is run again), and marks them as completed or failed at the time when that is
    so: those without any chunk, and with ``enrich`` (whose answers are the chunks' column ``enriched``) those of which a chunk
    failed. Chunks of failed texts are not written; a later batch that brings such a text tries again.
    """
    manifest_ = manifest_table(manifest_path)

    def mark(files: DataFrame, batch: int) -> None:
        started = manifest_.lookup(files.select(F.lit(collection).alias("collection"), "file_hash")).select("file_hash", "started_at")
        rows = files.join(started, "file_hash", "left").select(
            F.lit(collection).alias("collection"), "file_hash", "status", F.coalesce("started_at", F.current_timestamp()).alias("started_at"), F.current_timestamp().alias("updated_at"),
            F.substring("error", 1, 512).alias("error"), F.lit(batch).cast("long").alias("batch"))
        manifest_.upsert(rows)

    def write(batch: DataFrame, number: int) -> None:
        own = batch.where("text is not null").withColumn("file_hash", F.sha2("text", 256))
        known = manifest_.lookup(own.select(F.lit(collection).alias("collection"), "file_hash")).where((F.col("status") == "completed") & (F.col("batch") != number))
        firsts = own.groupBy("file_hash").agg(F.min_by(F.struct(*batch.columns), F.struct("doc_id", *batch.columns)).alias("d")).join(known.select("file_hash"), "file_hash", "left_anti")
        new = keep(firsts.select("file_hash", "d.*"), "new")
        none = F.lit(None).cast("string")
        mark(new.select("file_hash", F.lit("in_progress").alias("status"), none.alias("error")), number)
        chunks = chunks_of(new.drop("file_hash"))
        if enrich:
            chunks = plugs.enrich(chunks, ["node_id", "text"], enrich, "enriched").drop("calls")
        else:
            chunks = chunks.withColumn("error", none)
        chunks = keep(chunks, "chunks")
        fate = chunks.groupBy("file_hash").agg(F.min("error").alias("error"), F.lit(True).alias("has"))
        fate = new.select("file_hash").join(fate, "file_hash", "left").select("file_hash", F.when(F.col("has").isNull(), "no text").otherwise(F.col("error")).alias("error"))
        fate = keep(fate.withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed")), "fate")
        good = chunks.join(fate.where("status = 'completed'").select("file_hash"), "file_hash", "left_semi").select(*(c for c in chunks.columns if c != "error"))
        good.write.mode("overwrite").parquet(f"{chunks_path}/batch={number}")
        mark(fate, number)
        discard(new, chunks, fate)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_table(path).read(spark)


def search_text(stream: DataFrame) -> DataFrame:
    return stream.withColumn("search_text", t.clean(F.col("text")))
