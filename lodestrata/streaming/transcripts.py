"""Transcripts of media, made once for each content: a table by content hash that batches join and write back to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import plugs
from ..operators.kept import keep
from ..sources import tables
from ..sources.keyed import KeyedTable

# The fields of a posting that its media carry, each under its name with a prefix.
POSTING_FIELDS = ("network", "author", "author_id", "vanity", "timestamp", "url", "text")


def cache_table(path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(path, "file_hash string, transcript string, made_at timestamp", ("file_hash",), ("made_at",), buckets)


def transcribe(media: DataFrame, cache: KeyedTable, plug: plugs.Plug, claimed: DataFrame | None = None) -> DataFrame:
    """(path, file_hash, transcript, cached, error) of media (path, content) that nobody has claimed.

    claimed: (path) of files that another ingest handles, such as the media of postings. Contents whose hash is in the cache are not
    sent to the plug, equal ones once; what it answers goes into the cache, what failed has its error and is tried again next time.
    Rows without content are left out.
    """
    if claimed is not None:
        media = media.join(claimed.select("path").distinct(), "path", "left_anti")
    own = keep(media.where("content is not null").select("path", F.sha2("content", 256).alias("file_hash"), "content"), "media")
    hashes = own.select("file_hash").distinct()
    known = keep(cache.lookup(hashes), "known")
    missing = own.join(known.select("file_hash"), "file_hash", "left_anti")
    firsts = missing.groupBy("file_hash").agg(F.min("path").alias("path"))
    made = keep(plugs.enrich(missing.join(firsts, ["file_hash", "path"], "left_semi").dropDuplicates(["file_hash"]), ["path", "content"], plug, "transcript").select("file_hash", "transcript", "error"), "made")
    cache.upsert(made.where("error is null and transcript is not null").select("file_hash", "transcript", F.current_timestamp().alias("made_at")))
    both = known.select("file_hash", "transcript", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error")).unionByName(made.select("file_hash", "transcript", F.lit(False).alias("cached"), "error"))
    return own.select("path", "file_hash").join(both, "file_hash").select("path", "file_hash", "transcript", "cached", "error")


def follow(media: DataFrame, cache: KeyedTable, plug: plugs.Plug, out: str, checkpoint: str, claimed: DataFrame | None = None) -> StreamingQuery:
    """transcribe() for each batch of a stream of media, into a folder of the batch's number."""

    def write(batch: DataFrame, number: int) -> None:
        transcribe(batch, cache, plug, claimed).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return media.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def posting_references(postings: DataFrame) -> DataFrame:
    """(posting_id, reference map<string,string>) of a postings export: its fields with a prefix, blank ones left out. Other tables have none.

    Of several rows of a posting the one with the greatest values stays.
    """
    spark = postings.sparkSession
    if tables.profile(postings.columns) != "postings":
        return spark.createDataFrame([], "posting_id string, reference map<string,string>")
    fields = F.array(*(F.struct(F.lit(f"posting_{k}").alias("key"), tables.cell(postings, tables.REFERENCE["postings"][k]).alias("value")) for k in POSTING_FIELDS))
    rows = postings.select(tables.cell(postings, "posting id").alias("posting_id"), F.filter(fields, lambda x: x["value"].isNotNull()).alias("f")).where("posting_id is not null")
    return rows.groupBy("posting_id").agg(F.map_from_entries(F.max("f")).alias("reference"))
