"""Rows of the exports: one list of columns each, every cell text, empty where a row has nothing to say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# The columns of the exports, in order.
POSTING = ("url", "posting_uuid", "posting_id", "media_id", "posting_network", "posting_author", "posting_author_id", "posting_vanity", "posting_timestamp", "posting_url", "posting_text")
FINDING = ("network", "ref_type", "uuid", "timestamp", "author", "author_id", "vanity", "text_id", "anchor_text", "parent_text", *POSTING, "translation")
ENTITY_SOURCES = ("entity", "source", "page", "row", "chunk_id", "chunk_text", *FINDING)
FLAGGED = ("source", "page", "row", "chunk_id", "category", "confidence", "reason", "chunk_text", *FINDING)
SEARCH = (
    "marked", "kind", "source", "page", "row", "chunk_id", "chunk_text", "network", "author", "author_id", "vanity", "url", "timestamp", "posting_network", "posting_author", "posting_author_id",
    "posting_vanity", "posting_timestamp", "posting_url", "posting_text", "type", "uuid", "posting_uuid", "posting_id", "media_id", "speaker", "language", "detected_language", "source_file",
)
DOCUMENTS = ("filename", "mimetype", "file_hash", "node_count", "page_count", "max_rows", "max_duration", "entity_types")
ENTITIES = ("rank", "entity", "type", "mentions")


def rows(df: DataFrame, columns: tuple[str, ...], **given: Column) -> DataFrame:
    """df as an export. A cell comes from ``given``, else from the column of its name, else from the field of its name in
    the struct ``reference``, else it is empty; lists are joined by semicolons."""
    kinds = dict(df.dtypes)
    ref = df.schema["reference"].dataType.names if kinds.get("reference", "").startswith("struct") else []

    def cell(name: str) -> Column:
        field = "type" if name == "ref_type" else name
        if name in given:
            c = given[name]
        elif name in kinds:
            return t.csv_cell(F.col(f"`{name}`"), kinds[name].startswith("array"))
        else:
            c = F.col("reference")[field] if field in ref else F.lit(None)
        return t.csv_cell(c)

    return df.select(*[cell(c).alias(c) for c in columns])


def entity_sources(chunks: DataFrame, entity: str) -> DataFrame:
    """Chunks (node_id, filename, text; reference) in which an entity was found."""
    return rows(chunks, ENTITY_SOURCES, entity=F.lit(entity), source=F.col("filename"), chunk_id=F.col("node_id"), chunk_text=F.col("text"))


def flagged(chunks: DataFrame) -> DataFrame:
    """Chunks with a flag (category, confidence, reason)."""
    return rows(chunks, FLAGGED, source=F.col("filename"), chunk_id=F.col("node_id"), chunk_text=F.col("text"))


def search(found: DataFrame, marked: list[str] = ()) -> DataFrame:
    """Chunks (node_id, filename, text; kind, page, row, reference) that a search found, whole; those chosen by hand are marked."""
    kind = F.coalesce(t.non_blank(F.col("kind")), F.lit("text")) if "kind" in found.columns else F.lit("text")
    chosen = F.when(F.col("node_id").isin(list(marked)), "true").otherwise("false")
    return rows(found, SEARCH, marked=chosen, kind=kind, source=F.col("filename"), chunk_id=F.col("node_id"), chunk_text=F.col("text"))


def entities(top: DataFrame) -> DataFrame:
    return rows(top, ENTITIES, entity=F.coalesce(t.non_blank(F.col("text")), F.lit("Unknown")))


def documents(listed: DataFrame) -> DataFrame:
    """The list of documents; no rows and no duration are left empty."""
    return rows(listed, DOCUMENTS, max_rows=F.nullif(F.col("max_rows"), F.lit(0)))
