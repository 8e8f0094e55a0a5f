"""What an answer stands on: source rows of stored payloads, and the text of an answer's sources under one budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as lb
from ..functions import text as t

# Under which names a payload may hold its text, and an answer's sources that are shown.
TEXT_KEYS = ("text", "chunk_text", "chunk", "content")
MOST_SOURCES, BUDGET = 6, 48_000


def member(payload: Column, *paths: str) -> Column:
    """The first of several members that is not missing, empty or false."""
    found = [F.get_json_object(payload, f"$.{p}") for p in paths]
    return F.coalesce(*[F.when(~c.isin("", "0", "false", "[]", "{}"), c) for c in found])


def payload_text(payload: Column) -> Column:
    """The stripped text of a stored payload (JSON), or of the node that it holds as JSON or as a text of JSON; empty if there is none."""
    node = F.get_json_object(payload, "$._node_content")
    return F.coalesce(*[t.non_blank(F.get_json_object(c, f"$.{k}")) for c in (payload, node) for k in TEXT_KEYS], F.lit(""))


def file_hash(payload: Column) -> Column:
    """A payload's own hash, its origin's, or that of one of the three places where readers put theirs."""
    return member(payload, "origin.file_hash", "file_hash", "source_doc_id", *(f"{k}{o}.file_hash" for k in ("metadata", "meta", "extra_info") for o in ("", ".origin")))


def page_of(payload: Column) -> Column:
    """The page: a field, else the first that the provenances, or those of the document's items, name."""
    direct = F.coalesce(member(payload, "page", "page_number", "origin.page", "origin.page_number"), F.get_json_object(payload, "$.origin.page_no"))
    listed = F.from_json(F.coalesce(member(payload, "provenance"), member(payload, "provenances")), "array<struct<page_no:string>>")
    items = F.from_json(F.get_json_object(payload, "$.doc_items"), "array<struct<prov:array<struct<page_no:string>>>>")
    first = lambda a: F.get(F.filter(F.transform(a, lambda x: x["page_no"]), lambda x: x.isNotNull()), F.lit(0))
    nested = first(F.flatten(F.filter(F.transform(items, lambda x: x["prov"]), lambda x: x.isNotNull())))
    return F.coalesce(direct, first(listed), nested).try_cast("int")


def source_rows(points: DataFrame, collection: str, payload: str = "payload", kind_key: str = "doc_kind") -> DataFrame:
    """points with the fields of their source: text, preview_text, filename, filetype, source, file_hash, page, row, id, chunk_id,
    citation_index, preview_url, posting_uuid, image_id, n_rows, n_cols, style.

    points: (node_id, payload as JSON text), with a score if there is one; fields that a payload doesn't have are null. An image's text is
    its printed text, description and tags; a segment of a transcript (by ``kind_key``) has its number as row. Payloads that are null or
    no JSON have empty texts.
    """
    p = F.coalesce(F.col(payload), F.lit("{}"))
    path = F.regexp_extract(F.get_json_object(p, "$.source_path"), r"([^/]+)/*$", 1)
    caption = lb.caption(F.get_json_object(p, "$.ocr_text"), F.get_json_object(p, "$.llm_description"), F.from_json(F.get_json_object(p, "$.llm_tags"), "array<string>"))
    source = member(p, "source", "source_type", "reader")
    row = F.coalesce(F.get_json_object(p, "$.table.row_index"), F.when(F.get_json_object(p, f"$.{kind_key}") == "transcript_segment", F.get_json_object(p, "$.sentence_index")))
    chunk = member(p, "chunk_id", "image_id")
    table = lambda k: F.when(source == "table", F.get_json_object(p, f"$.table.{k}"))
    out = points.withColumns({
        "text": F.coalesce(F.nullif(payload_text(p), F.lit("")), caption), "filename": F.coalesce(member(p, "origin.filename", "file_name", "filename", "file_path"), F.nullif(path, F.lit(""))),
        "filetype": member(p, "origin.filetype", "origin.mimetype", "filetype", "mimetype", "mime_type", "file_type", "file_format"), "source": source, "file_hash": file_hash(p), "page": page_of(p), "row": row.try_cast("int"),
        "id": F.coalesce(F.nullif(F.col("node_id"), F.lit("")), member(p, "node_id"), chunk), "chunk_id": chunk, "citation_index": F.get_json_object(p, "$.citation_index").try_cast("int"),
        "posting_uuid": member(p, "posting_uuid"), "image_id": member(p, "image_id"), "n_rows": table("n_rows"), "n_cols": table("n_cols"), "style": table("style"),
    })
    url = F.concat(F.lit(f"/sources/preview?collection={collection}&file_hash="), "file_hash")
    return out.withColumn("preview_text", t.strip(F.substring("text", 1, 280))).withColumn("preview_url", url).drop(payload)


def allowances(lengths: Column, budget: int) -> Column:
    """How much of each text may be shown: the shortest first, each its length or an equal share of what is left. lengths: a short array."""
    order = F.array_sort(F.transform(lengths, lambda n, i: F.struct(n.alias("n"), i.alias("i"))))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.size(lengths).cast("long").alias("n"), F.array().cast("array<struct<i:int,got:bigint>>").alias("out"))

    def fold(state: Column, x: Column) -> Column:
        got = F.least(x["n"].cast("long"), F.floor(state["left"] / state["n"]))
        return F.struct((state["left"] - got).alias("left"), (state["n"] - 1).alias("n"), F.concat(state["out"], F.array(F.struct(x["i"].alias("i"), got.alias("got")))).alias("out"))

    return F.transform(F.array_sort(F.aggregate(order, start, fold, lambda s: s["out"])), lambda x: x["got"])


def shown(text: Column, allowance: Column) -> Column:
    """The text, or its beginning and how much of it isn't shown."""
    n = F.length(text)
    return F.when(n <= allowance, text).otherwise(F.concat(F.substring(text, F.lit(1), allowance.cast("int")), F.format_string("[... %d of %d characters not shown ...]", n - allowance, n)))


def sources_text(sources: DataFrame, by: str = "query_id", most: int = MOST_SOURCES, budget: int = BUDGET) -> DataFrame:
    """(by, sources, truncated): the first ``most`` sources of each answer as one text, and whether any of it was cut; '(none)' never
    occurs, as an answer without sources has no row.

    sources: (by, position, filename, page, row, text, reference; citation_index if there is one). Each has a line that names it, its reference, and
    its text; the texts share ``budget`` characters. A source with neither text nor reference is told as JSON.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy("position"))
    own = sources.withColumn("__n", place).where(F.col("__n") <= most)
    fields = own.schema["reference"].dataType.names
    body = F.coalesce(F.col("text"), F.lit(""))
    meta = F.when(body != "", lb.reference_block(F.col("reference"), fields, ("text",))).otherwise(lb.reference_block(F.col("reference"), fields))
    number = F.coalesce("citation_index", "__n") if "citation_index" in own.columns else F.col("__n")
    gap = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    head = F.concat(F.lit("Source "), number.cast("string"), F.lit(" ["), F.coalesce(F.nullif("filename", F.lit("")), F.lit("Unknown")), F.lit(" | page="), gap("page"), F.lit(" | row="), gap("row"), F.lit("]:"))
    whole = F.to_json(F.struct("filename", "page", "row", "text"))
    rows = own.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), head.alias("head"), F.coalesce(meta, F.lit("")).alias("meta"), body.alias("body"), whole.alias("whole")))).alias("s"))
    rows = rows.withColumn("a", allowances(F.transform("s", lambda x: F.length(x["body"])), budget))

    def one(x: Column, a: Column) -> Column:
        room = F.when(a > 0, a).otherwise(F.lit(budget).cast("long"))
        last = F.when(x["body"] != "", F.concat(F.lit("Text: "), shown(x["body"], a))).when(x["meta"] == "", shown(x["whole"], room))
        cut = F.when(x["body"] != "", F.length(x["body"]) > a).otherwise((x["meta"] == "") & (F.length(x["whole"]) > room))
        return F.struct(F.concat_ws("\n", x["head"], F.nullif(x["meta"], F.lit("")), last).alias("text"), cut.alias("cut"))

    parts = F.zip_with("s", "a", one)
    return rows.select(by, F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("sources"), F.exists(parts, lambda x: x["cut"]).alias("truncated"))
