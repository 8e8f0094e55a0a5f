"""Table files as row documents."""

from __future__ import annotations

import csv
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

# Columns that name a row's text, in order of preference.
TEXT_COLUMNS = ("title", "headline", "subject", "text", "text content", "content", "body", "message", "description", "abstract", "summary")
# Headers of the known social exports.
PROFILES = {
    "comments": ("UUID", "Comment ID", "Network Object ID", "URL", "Crawled at", "Network", "Text Content", "Timestamp", "Tags", "Author ID", "Author", "Vanity Name", "Replies Count", "Reactions Count", "Parent Comment Text", "Parent Comment ID", "Posting Text", "Posting ID"),
    "messages": ("UUID", "Chat ID", "Sender", "Timestamp", "Text", "Tags", "URL", "Chat Group", "Answers Count", "Reply To", "Network"),
    "postings": ("UUID", "Posting ID", "URL", "Date last updated", "Timestamp", "Timezone", "Crawled at", "Postings Connections", "Network Posting ID", "Location", "Author ID", "Author", "Vanity Name", "Co-Author", "Quoted User", "Expected Reactions", "Collected Reactions", "Expected Comments", "Collected Comments", "Network", "Posted in Group", "Task", "Text Content", "Filename", "Tags"),
}
# The columns of each export that its reference fields come from, and the one that names its documents.
REFERENCE = {
    "comments": {"network": "network", "uuid": "uuid", "timestamp": "timestamp", "author": "author", "author_id": "author id", "vanity": "vanity name", "text": "text content", "text_id": "comment id", "parent_text": "parent comment text", "anchor_text": "posting text"},
    "messages": {"network": "network", "uuid": "uuid", "timestamp": "timestamp", "author": "sender", "author_id": None, "vanity": None, "text": "text", "text_id": "chat id", "parent_text": "reply to", "anchor_text": None},
    "postings": {"network": "network", "uuid": "uuid", "url": "url", "timestamp": "timestamp", "author": "author", "author_id": "author id", "vanity": "vanity name", "text": "text content", "text_id": "posting id", "parent_text": None, "anchor_text": None},
}


def separator(sample: str) -> str:
    """Delimiter of a CSV text's head: by the sniffer, else the commonest, else a comma."""
    marks = ",;\t|"
    try:
        return csv.Sniffer().sniff(sample[:8192], delimiters=marks).delimiter
    except csv.Error:
        best = max(marks, key=sample[:8192].count)
        return best if sample.count(best) else ","


def profile(columns: list[str]) -> str | None:
    """The social export whose headers these are, in any case and order."""
    have = {c.strip().casefold() for c in columns}
    return next((k for k, v in PROFILES.items() if have == {c.casefold() for c in v}), None)


def is_media_manifest(columns: list[str]) -> bool:
    return {"media id", "exported media filename"} <= {c.strip().casefold() for c in columns}


def text_columns(df: DataFrame) -> list[str]:
    """Columns that make a row's text: a preferred name, else up to three string columns with long values in the first 200 rows, else the first."""
    named = {c.strip().casefold(): c for c in df.columns}
    if got := [named[c] for c in TEXT_COLUMNS if c in named]:
        return got[:1]
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if strings:
        means = df.limit(200).agg(*[F.avg(F.length(f"`{c}`")).alias(c) for c in strings]).first()
        if got := [c for c in strings if (means[c] or 0) >= 12][:3]:
            return got
    return df.columns[:1]


def cell(df: DataFrame, name: str | None):
    """A column by its name in any case, blank cells null; null where df has no such column."""
    named = {c.strip().casefold(): c for c in df.columns}
    return t.non_blank(F.col(f"`{named[name]}`").cast("string")) if name in named else F.lit(None).cast("string")


def reference(df: DataFrame, kind: str):
    """The reference struct of a social row; what its export lacks is null."""
    return F.struct(F.lit(kind.removesuffix("s")).alias("type"), *(cell(df, name).alias(k) for k, name in REFERENCE[kind].items()))


def rows(df: DataFrame, columns: list[str] | None = None, where: str | None = None, limit: int | None = None) -> DataFrame:
    """Row documents: text (non-blank), metadata as JSON, and for social exports their reference and, as doc_id, the id of its text."""
    kind = profile(df.columns)
    columns = columns or text_columns(df)
    if where:
        df = df.where(F.expr(where))
    text = t.strip(F.concat_ws("\n", *[t.non_blank(F.col(f"`{c}`").cast("string")) for c in columns]))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    out = df.select(text.alias("text"), F.to_json(F.struct(*rest)).alias("metadata") if rest else F.lit("{}").alias("metadata"), F.lit(kind or "table").alias("style"), *([reference(df, kind).alias("reference_metadata"), cell(df, REFERENCE[kind]["text_id"]).alias("doc_id")] if kind else []))
    out = out.where("text <> ''")
    return out.limit(limit) if limit is not None else out


def read(spark: SparkSession, path: str, multi_line: bool = True, **options) -> DataFrame:
    """CSV, TSV or Parquet as it is: every CSV column is a string, the delimiter is sniffed from the first lines that Spark reads.

    Cells may hold line breaks, for which Spark reads a file in one task. ``multi_line=False`` splits large files
    among tasks, where no cell holds one.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    head = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())
    sep = "\t" if path.endswith(".tsv") else separator(head.lstrip("\ufeff"))
    return spark.read.options(header=True, sep=sep, multiLine=multi_line, escape='"', **options).csv(path)


def media_links(manifest: DataFrame, postings: DataFrame, files: DataFrame) -> DataFrame:
    """Media rows with the UUID of their posting and their file. A posting is found by Network ID, else Media ID, else
    Media ID without its counter; files by lower-case base name. Rows without either are left out."""
    from ..operators.postprocess import first_key_join

    index = postings.select(F.col("`Posting ID`").alias("pid"), F.col("UUID").alias("posting_uuid")).where("pid is not null and posting_uuid is not null")
    index = index.groupBy("pid").agg(F.max("posting_uuid").alias("posting_uuid"))
    network = F.col("`Network ID`") if "Network ID" in manifest.columns else F.lit(None)
    linked = first_key_join(manifest, [network, F.col("`Media ID`"), t.strip_counter(F.col("`Media ID`"))], index, "pid", "posting_uuid").where("posting_uuid is not null")
    names = files.select(F.lower(F.regexp_extract("path", r"([^/]+)$", 1)).alias("base"), "path").groupBy("base").agg(F.min("path").alias("path"))
    return linked.withColumn("base", F.lower(F.regexp_extract(F.col("`Exported media filename`"), r"([^/]+)$", 1))).join(names, "base")


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is blank."""
    return df.where(reduce(and_, [t.non_blank(F.col(f"`{c}`").cast("string")).isNotNull() for c in columns]))
