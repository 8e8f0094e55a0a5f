"""Sessions, turns, reports and the ingest manifest as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

ERROR_CHARS = 512


def sessions(turns: DataFrame) -> DataFrame:
    """conv_id, title (the first user text), turns, last role."""
    return turns.groupBy("conv_id").agg(
        t.title(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))).alias("title"),
        F.count(F.lit(1)).alias("turns"), F.max_by("role", "turn").alias("last_role"),
    )


def exchanges(turns: DataFrame) -> DataFrame:
    """Every user turn with the answer next to it, numbered within its conversation, and the question before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    with_next = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    asked = with_next.where("role = 'user'")
    return asked.select(
        "conv_id", F.row_number().over(w).alias("number"), F.col("text").alias("question"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"),
        F.lag("text").over(w).alias("prior_question"),
    )


def context(turns: DataFrame, last: int) -> DataFrame:
    """The last turns of every conversation, in order."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("back", back).where(F.col("back") <= last)


def transcript(turns: DataFrame) -> DataFrame:
    """conv_id and its markdown; a conversation is gathered in one row."""
    line = F.concat(F.lit("**"), F.col("role"), F.lit(":** "), F.coalesce("text", F.lit("")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("markdown"))


def collapse(items: DataFrame, key: str, order: str, labels: str) -> DataFrame:
    """Report items with one key as one: distinct labels in the order of their first place."""
    firsts = items.groupBy(key, labels).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    return firsts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.col(labels).alias("l")))), lambda x: x["l"]), "; ").alias("labels"), F.sum("n").alias("items"), F.min("first").alias("position"))


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows whose keys it doesn't have, each key once."""
    return table.unionByName(rows.dropDuplicates(keys).join(table, keys, "left_anti"))


def reorder(items: DataFrame, key: str, position: str, listed: list[str]) -> DataFrame:
    """Listed items first in the given order, then the others as they were."""
    spark = items.sparkSession
    want = spark.createDataFrame([(k, i) for i, k in enumerate(listed)], f"{key} {dict(items.dtypes)[key]}, __at int")
    out = items.join(F.broadcast(want), key, "left")
    return out.withColumn(position, F.row_number().over(Window.orderBy(F.asc_nulls_last("__at"), position, key))).drop("__at")


def merge_manifest(events: DataFrame) -> DataFrame:
    """The manifest after a batch of (collection, file_hash, status, at, error): a start never takes back a completion, a failure does.

    A fold over any number of events by two aggregates: the last decisive event (completed or failed), and the first start.
    Errors are cut to ERROR_CHARS characters, the last of which shows the cut. Events without collection or hash are none.
    """
    events = events.where("collection <> '' and file_hash <> ''")
    error = F.when(F.length("error") > ERROR_CHARS, F.concat(F.substring("error", 1, ERROR_CHARS - 1), F.lit("…"))).otherwise(F.nullif("error", F.lit("")))
    decisive = F.when(F.col("status").isin("completed", "failed"), F.struct("at", "status", error.alias("error")))
    out = events.groupBy("collection", "file_hash").agg(F.min(F.when(F.col("status") == "started", F.col("at"))).alias("started_at"), F.max(decisive).alias("d"), F.max("at").alias("updated_at"), F.max(F.when(F.col("status") == "started", F.col("at"))).alias("last_start"))
    status = F.when(F.col("d").isNull(), "in_progress").when((F.col("d.status") == "failed") & (F.col("last_start") > F.col("d.at")), "in_progress").otherwise(F.col("d.status"))
    return out.select("collection", "file_hash", status.alias("status"), "started_at", "updated_at", F.when(status == "failed", F.col("d.error")).alias("error"))


def citations(turns: DataFrame, cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """The citations of all turns: conv_id, turn, position, node_id, filename, text.

    cited: (conv_id, turn, position, node_id, filename, text). What a citation doesn't hold itself comes from its chunk;
    citations of turns that aren't there go.
    """
    stored = chunks.select("node_id", F.col("filename").alias("__filename"), F.col("text").alias("__text"))
    own = cited.join(turns.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi").join(stored, "node_id", "left")
    return own.select("conv_id", "turn", "position", "node_id", F.coalesce("filename", "__filename").alias("filename"), F.coalesce("text", "__text").alias("text"))


def cited_files(citations_: DataFrame) -> DataFrame:
    """The distinct files that each conversation cites."""
    return citations_.where("filename is not null").select("conv_id", "filename").distinct()


def _last(kind: str, value: str, at: Column) -> Column:
    return F.max(F.when(F.col("kind") == kind, F.struct(at, F.col(value).alias("v"))))["v"]


def fold_sessions(log: DataFrame) -> DataFrame:
    """Sessions after a log of (conv_id, at, kind, value): owner and collection of the last ``open``, the last ``scope`` and ``validation``.

    ``drop`` deletes a session with all that was set before; a session lives on if it is opened again.
    """
    dropped = log.where("kind = 'drop'").groupBy("conv_id").agg(F.max("at").alias("dropped_at"))
    alive = log.join(dropped, "conv_id", "left").where("dropped_at is null or at > dropped_at")
    out = alive.groupBy("conv_id").agg(
        _last("open", "value", F.col("at")).alias("collection"), _last("scope", "value", F.col("at")).alias("scope"),
        _last("validation", "value", F.col("at")).alias("validation"), F.max("at").alias("updated_at"),
    )
    return out.where("collection is not null")


def fold_items(log: DataFrame) -> DataFrame:
    """Items of reports after a log of (report_id, item_id, at, kind, value): ``add`` (value: its dedupe key), ``remove``, ``note``.

    An item is there if its last add comes after its last remove; its place is that of its first add since. Of items with one
    dedupe key the first stays.
    """
    gone = log.where("kind = 'remove'").groupBy("report_id", "item_id").agg(F.max("at").alias("removed_at"))
    alive = log.join(gone, ["report_id", "item_id"], "left").where("removed_at is null or at > removed_at")
    items = alive.groupBy("report_id", "item_id").agg(
        F.min(F.when(F.col("kind") == "add", F.col("at"))).alias("added_at"), F.min(F.when(F.col("kind") == "add", F.struct("at", "value")))["value"].alias("dedupe_key"),
        _last("note", "value", F.col("at")).alias("note"),
    ).where("added_at is not null")
    first = F.row_number().over(Window.partitionBy("report_id", "dedupe_key").orderBy("added_at", "item_id"))
    items = items.withColumn("__n", F.when(F.col("dedupe_key").isNull(), 1).otherwise(first)).where("__n = 1").drop("__n")
    return items.withColumn("position", F.row_number().over(Window.partitionBy("report_id").orderBy("added_at", "item_id")))


def listed(reports: DataFrame, owner: str = "owner", at: str = "updated_at", key: str = "report_id") -> DataFrame:
    """Rows of every owner, the latest first: ``place`` from 1."""
    return reports.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at), key)))


def published(log: DataFrame) -> DataFrame:
    """Summaries that may be served after a log of (collection, at, kind, expected, payload): compare and set by revision.

    ``bump`` raises a collection's revision by one. ``store`` takes effect only if it expects the revision of its moment, and its
    payload is served while no later bump came: collection, revision, payload (null: none).
    """
    w = Window.partitionBy("collection").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = log.withColumn("revision", F.count_if(F.col("kind") == "bump").over(w))
    ok = (F.col("kind") == "store") & (F.col("expected") == F.col("revision"))
    out = seen.groupBy("collection").agg(F.max("revision").alias("revision"), F.max(F.when(ok, F.struct("at", "revision", "payload"))).alias("s"))
    return out.select("collection", "revision", F.when(F.col("s.revision") == F.col("revision"), F.col("s.payload")).alias("payload"))


# Kinds of a report's items, and the file of each in a bundle.
BUNDLE = {"entity": "entity-findings", "hate_speech": "hate-speech", "chat": "chat-answers", "summary": "summaries"}


def merged_findings(items: DataFrame, joint: str = " · ") -> DataFrame:
    """Entity findings of a report that show one chunk as one: (report_id, key, position, labels, notes, entities, translation).

    items: (report_id, position, chunk_id, filename, page, row, chunk_text, entity_label, note, entities array<string>, translation). The key is
    the chunk's id, or file, place and text of old items without one. Labels and notes are those of all, each once, in the order
    in which they came; entities are joined whole; the first translation there is stays.
    """
    key = F.coalesce(t.non_blank(F.col("chunk_id")), F.to_json(F.struct("filename", "page", "row", "chunk_text"), {"ignoreNullFields": "false"}))
    each = items.select("report_id", "position", key.alias("key"), t.non_blank(F.col("entity_label")).alias("label"), t.non_blank(F.col("note")).alias("note"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), t.non_blank(F.col("translation")).alias("translation"))
    all_ = each.groupBy("report_id", "key").agg(F.min("position").alias("position"), F.array_sort(F.collect_list(F.struct("position", "label", "note", "entities", "translation"))).alias("i"))
    once = lambda k: F.array_join(F.array_distinct(F.array_compact(F.transform("i", lambda x: x[k]))), joint)
    return all_.select("report_id", "key", "position", once("label").alias("labels"), F.nullif(once("note"), F.lit("")).alias("notes"), F.flatten(F.transform("i", lambda x: x["entities"])).alias("entities"), F.get(F.array_compact(F.transform("i", lambda x: x["translation"])), F.lit(0)).alias("translation"))


def write_bundle(items: DataFrame, columns: dict[str, tuple[str, ...]], path: str) -> list[str]:
    """A report's items (kind, position, and any columns) as one CSV folder for each kind that has any, named after its file; their names.

    columns: of each kind. The kinds are told apart by one count; rows go in the order of their positions.
    """
    from .search import write_csv

    have = {r.kind for r in items.groupBy("kind").count().collect()}
    names = []
    for kind, name in BUNDLE.items():
        if kind in have:
            own = items.where(F.col("kind") == kind).orderBy("position")
            write_csv(own.select(*(F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in columns[kind])), f"{path}/{name}")
            names.append(name)
    return names
