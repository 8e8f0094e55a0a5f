"""Labels, references and small checks of sources as Column builders; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t

# Fields of a reference, in the order in which they are shown, and their labels.
REFERENCE_LABELS = {
    "network": "Network", "type": "Type", "uuid": "UUID", "posting_uuid": "Posting UUID", "posting_id": "Posting ID", "media_id": "Media ID",
    "url": "URL", "posting_network": "Posting Network", "posting_author": "Posting Author", "posting_author_id": "Posting Author ID",
    "posting_vanity": "Posting Vanity", "posting_timestamp": "Posting Timestamp", "posting_url": "Posting URL", "posting_text": "Posting Text",
    "timestamp": "Timestamp", "author": "Author", "author_id": "Author ID", "vanity": "Vanity", "text": "Text", "text_id": "Text ID",
    "parent_text": "Parent Text", "anchor_text": "Anchor Text", "speaker": "Speaker", "language": "Language",
    "detected_language": "Detected Language", "source_file": "Source File",
}
# Networks that name a pipeline and no posting's network.
INTERNAL_NETWORKS = ("nextext",)


def number(c: Column) -> Column:
    """The value as a double, null if it is none."""
    return c.try_cast("double")


def first_text(*columns: Column) -> Column:
    """The first text that isn't blank, stripped."""
    return F.coalesce(*[t.non_blank(c) for c in columns])


def source_label(name: Column, page: Column, row: Column) -> Column:
    """``name (p3, row 7)`` with the parts that are there."""
    at = F.concat_ws(", ", F.concat(F.lit("p"), page.cast("string")), F.concat(F.lit("row "), row.cast("string")))
    known = F.coalesce(t.non_blank(name), F.lit("Unknown"))
    return F.when(at == "", known).otherwise(F.concat(known, F.lit(" ("), at, F.lit(")")))


def source_line(name: Column, page: Column, row: Column, score: Column | None = None) -> Column:
    """``name (Page 3) [0.123]``: the page goes before the row, the score is left out where it isn't given."""
    at = F.coalesce(F.concat(F.lit("(Page "), page.cast("string"), F.lit(")")), F.concat(F.lit("(Row "), row.cast("string"), F.lit(")")))
    return F.concat_ws(" ", F.nullif(name, F.lit("")), at, *([] if score is None else [F.format_string("[%.3f]", score)]))


def markdown_cell(c: Column) -> Column:
    """A text as one cell of a Markdown table."""
    return F.regexp_replace(F.replace(F.coalesce(t.strip(c), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", "<br>")


def date_only(c: Column) -> Column:
    """The day of an ISO time, else its first ten characters; empty for nothing."""
    s = F.coalesce(t.strip(c), F.lit(""))
    return F.coalesce(s.try_cast("date").cast("string"), F.substring(s, 1, 10))


def has_blank(c: Column) -> Column:
    """Has the text a word border? So has an empty one."""
    return (c == "") | c.rlike(r"(?U)\s")


def file_fragment(c: Column, default: str = "collection") -> Column:
    """Letters, digits, dots, dashes and underscores only."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(t.strip(c), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def elapsed(seconds: Column) -> Column:
    """MM:SS, from an hour on H:MM:SS, from a day on ``Nd HH:MM:SS``; 00:00 for what is no time."""
    s = F.when((seconds > 0) & ~F.isnan(seconds) & (seconds < 1e15), seconds).cast("long")
    days, hours, minutes, rest = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60
    out = F.when(days > 0, F.format_string("%dd %02d:%02d:%02d", days, hours, minutes, rest)).when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest))
    return F.when(s.isNull(), "00:00").otherwise(F.coalesce(out, F.format_string("%02d:%02d", minutes, rest)))


def caption(printed: Column, description: Column, tags: Column) -> Column:
    """What is known of an image: its printed text, its description, its tags; empty if nothing is."""
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    return F.concat_ws("\n\n", t.non_blank(printed), t.non_blank(description), listed)


def reference_items(ref: Column, fields: list[str], skip: tuple[str, ...] = ()) -> Column:
    """(label, value) of a reference struct that has these fields, in the labels' order and without blank values."""
    items = [F.struct(F.lit(v).alias("label"), t.non_blank(ref[k].cast("string")).alias("value")) for k, v in REFERENCE_LABELS.items() if k in fields and k not in skip]
    return F.filter(F.array(*items), lambda x: x["value"].isNotNull())


def reference_block(ref: Column, fields: list[str], skip: tuple[str, ...] = ()) -> Column:
    return F.array_join(F.transform(reference_items(ref, fields, skip), lambda x: F.concat(F.lit("- "), x["label"], F.lit(": "), x["value"])), "\n")


def posting_value(ref: Column, fields: list[str], key: str) -> Column:
    """A field of the posting: the prefixed one, else the bare one unless the row's own network is internal."""
    own = ref[f"posting_{key}"].cast("string") if f"posting_{key}" in fields else F.lit(None).cast("string")
    if key in fields:
        internal = F.lower(t.strip(ref["network"])).isin(*INTERNAL_NETWORKS) if "network" in fields else F.lit(False)
        own = F.coalesce(own, F.when(~F.coalesce(internal, F.lit(False)), ref[key].cast("string")))
    return F.coalesce(t.strip(own), F.lit(""))


def clarification(confidence: Column, entities: Column, asked: Column, threshold: float = 0.5, most: int = 2, need_entities: bool = False) -> Column:
    """Why to ask back, null if there is no need or it was done ``most`` times."""
    why = [F.when(confidence < threshold, "low confidence")]
    if need_entities:
        why.append(F.when(F.coalesce(F.size(entities), F.lit(0)) <= 0, "missing entities"))
    return F.when(asked < most, F.nullif(F.concat_ws(", ", *why), F.lit("")))


EVIDENCE = r"(?m)^EVIDENCE_INDICES:[ \t]*([0-9, \t]+)$"


def evidence(c: Column, ids: Column, most: int = 2) -> Column:
    """Those ids whose numbers (from 1) the text's last evidence line names, at most ``most``; the first id if it names none."""
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(EVIDENCE), 1), F.lit(-1))
    n = F.transform(F.split(F.coalesce(last, F.lit("")), ","), lambda x: F.trim(x).try_cast("int"))
    named = F.slice(F.transform(F.filter(n, lambda i: i.between(1, F.size(ids))), lambda i: F.element_at(ids, i)), 1, most)
    return F.when(F.size(named) > 0, named).otherwise(F.slice(ids, 1, 1))


def without_evidence(c: Column) -> Column:
    """The text without its evidence line, which is its last."""
    return t.strip(F.regexp_replace(c, EVIDENCE, ""))
