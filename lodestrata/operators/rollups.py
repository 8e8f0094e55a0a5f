"""Roll-ups of documents and collections, reconciliation and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def documents(chunks: DataFrame, entity_types: DataFrame | None = None) -> DataFrame:
    """One row for each filename: node_count, page_count, characters, first hash, entity types (sorted)."""
    out = chunks.groupBy("filename").agg(
        F.count(F.lit(1)).alias("node_count"), F.count_distinct("doc_id").alias("page_count"), F.sum(F.length("text")).alias("characters"),
        F.min_by("file_hash", F.struct("doc_id", "ord")).alias("file_hash"),
    )
    if entity_types is not None:
        kinds = entity_types.groupBy("filename").agg(F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("entity_types"))
        out = out.join(kinds, "filename", "left").withColumn("entity_types", F.coalesce("entity_types", F.lit("")))
    return out


def file_types(files: DataFrame, mime: str = "mimetype") -> DataFrame:
    """label, documents, nodes of (mimetype, nodes)."""
    return files.groupBy(t.mime_label(F.col(mime)).alias("label")).agg(F.count(F.lit(1)).alias("documents"), F.sum("nodes").alias("nodes"))


def profile(points: DataFrame) -> DataFrame:
    """What a collection is: shares of social and table rows, and the unit that coverage counts in."""
    p = points.agg(
        F.count(F.lit(1)).alias("points"), F.count_if("is_social").alias("social_points"), F.count_if("is_table").alias("table_points"),
        F.count_distinct("author").alias("authors"),
    )
    social = F.col("social_points") * 2 > F.col("points")
    return p.withColumns({"is_social": social, "is_table_heavy": F.col("table_points") * 2 > F.col("points"), "coverage_unit": F.when(social, "posts").otherwise("documents")})


def coverage(chunks: DataFrame, column: str = "search_text") -> DataFrame:
    """total, indexed, missing, status (not_indexed, partial, ok)."""
    c = chunks.agg(F.count(F.lit(1)).alias("total"), F.count(F.nullif(F.col(column), F.lit(""))).alias("indexed"))
    status = F.when(F.col("indexed") == 0, "not_indexed").when(F.col("indexed") < F.col("total"), "partial").otherwise("ok")
    return c.select("total", "indexed", (F.col("total") - F.col("indexed")).alias("missing"), status.alias("status"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of two stores: how many are in both, in one only; counted before they meet, so that a row is sent once for each key and task."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"), F.count_if(F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("l").isNull()).alias("right_only"), F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
    )


def flagged(chunks: DataFrame, flags: DataFrame, least: str = "low") -> DataFrame:
    """Chunks of flagged documents whose confidence (low < medium < high; unknown is low) reaches ``least``."""
    order = lambda c: F.when(F.lower(c) == "high", 2).when(F.lower(c) == "medium", 1).otherwise(0)
    f = flags.where("flag").where(order(F.col("confidence")) >= order(F.lit(least)))
    return chunks.join(f, "doc_id")


def containing(docs: DataFrame, passages: DataFrame, words: int = 4) -> DataFrame:
    """(query_id, doc_id): documents that hold a passage (query_id, passage).

    An equi-join on the hash of some words inside the passage finds the candidates, the text decides. A passage
    too short for that is looked for in every text. A text is split once and its words are laid beside the next ones,
    in time that goes with its length.
    """
    parts = F.split("passage", r"\s+")
    inside = F.struct(*[F.get(parts, F.lit(i)) for i in range(1, words + 1)])
    p = passages.withColumn("n", F.size(parts)).withColumn("key", F.when(F.col("n") >= words + 2, F.xxhash64(inside)))
    w = F.split("text", r"\s+")
    runs = F.arrays_zip(w, *[F.slice(w, i + 1, F.size(w)) for i in range(1, words)])
    keys = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.xxhash64("run").alias("key"))
    wanted = p.where("key is not null").select("query_id", "passage", "key")
    hit = keys.join(wanted.select("query_id", "key"), "key").select("query_id", "doc_id").distinct()
    found = hit.join(docs.select("doc_id", "text"), "doc_id").join(passages, "query_id").where(F.contains("text", "passage")).select("query_id", "doc_id")
    short = p.where("key is null")
    if short.take(1):
        found = found.union(docs.join(short, F.contains("text", "passage")).select("query_id", "doc_id"))
    return found


def hit_rates(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """Of every mode: queries, average latency, and the share of expectations met among queries that have any.

    retrieved: (mode, query_id, found array, latency_ms); expected: (query_id, wanted array).
    """
    r = retrieved.join(expected, "query_id", "left").withColumn("hit", F.arrays_overlap("found", "wanted"))
    return r.groupBy("mode").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.size("wanted") > 0).alias("expected_queries"),
        F.round(F.avg(F.when(F.size("wanted") > 0, F.coalesce(F.col("hit"), F.lit(False)).cast("int"))), 6).alias("hit_rate"),
    )


def overview(files: DataFrame, by: str) -> DataFrame:
    """Of each collection (files: by, filename, mimetype, node_count): document_count, node_count, file_types (label:count; the commonest first)."""
    kinds = files.groupBy(by, t.mime_label(F.col("mimetype")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("node_count").alias("nodes"))
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "label"))), lambda x: F.concat(x["label"], F.lit(":"), (-x["o"]).cast("string")))
    return kinds.groupBy(by).agg(F.sum("n").alias("document_count"), F.sum("nodes").alias("node_count"), F.array_join(order, ";").alias("file_types"))


def scope(chunks: DataFrame, ids: DataFrame, budget: int, key: str = "node_id") -> DataFrame:
    """Of chosen chunks: found, missing, est_tokens, fits."""
    own = ids.select(key).distinct().join(chunks.select(key, t.estimated_tokens(F.col("text")).alias("n")), key, "left")
    return own.agg(
        F.count("n").alias("found"), F.count_if(F.col("n").isNull()).alias("missing"), F.coalesce(F.sum("n"), F.lit(0)).alias("est_tokens"),
        (F.coalesce(F.sum("n"), F.lit(0)) <= budget).alias("fits"),
    )


def backfilled(chunks: DataFrame, text: Column, column: str = "search_text", force: bool = False) -> DataFrame:
    """chunks with their search text: rows that have one keep it unless forced. ``backfill`` says what was done: skipped, empty, written."""
    have = F.coalesce(F.col(column) != "", F.lit(False)) & F.lit(not force)
    new = t.non_blank(text)
    return chunks.withColumn("backfill", F.when(have, "skipped").when(new.isNull(), "empty").otherwise("written")).withColumn(column, F.when(have, F.col(column)).otherwise(new))


def backfill_counts(done: DataFrame) -> DataFrame:
    return done.agg(F.count(F.lit(1)).alias("scanned"), *[F.count_if(F.col("backfill") == k).alias(k) for k in ("written", "skipped", "empty")])


def inventory(files: DataFrame, name: Column, size: Column) -> DataFrame:
    """Files by their ending: ending (lower case; empty: none), files, bytes, label."""
    ending = F.lower(F.regexp_extract(name, r"(\.[^./?#\\]+)(?:[?#].*)?$", 1))
    out = files.groupBy(ending.alias("ending")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return out.withColumn("label", F.format_string("%s: %d (%d B)", F.coalesce(F.nullif(F.col("ending"), F.lit("")), F.lit("(none)")), F.col("files"), F.col("bytes")))
