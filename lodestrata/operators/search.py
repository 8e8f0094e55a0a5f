"""Keyword, phrase and field search; pages; exports.

A keyword is the prefix of some token; all keywords must match. With more than one word the words must also
stand together in one field. Predicates are built from functions only, so that they run inside the scan.
"""

from __future__ import annotations

import base64
import json
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

WORD = re.compile(r"[^\W]+", re.UNICODE)


def keywords(query: str) -> list[str]:
    """Words of two letters or more, each once in any case, in order."""
    out: dict[str, str] = {}
    for w in query.split():
        if len(w) >= 2:
            out.setdefault(w.casefold(), w)
    return list(out.values())


def phrase(c: Column, query: str) -> Column:
    """Do the words of the query stand together? True for a single keyword."""
    if len(query.split()) <= 1:
        return F.lit(True)
    return F.contains(F.lower(F.regexp_replace(t.strip(c), r"(?U)\s+", " ")), F.lit(" ".join(query.split()).lower()))


def has_keywords(c: Column, query: str) -> Column:
    """Every part of every keyword is a prefix of a token. A regular expression stops at the first hit and needs no token array."""
    parts = [p for k in keywords(query) for p in WORD.findall(k.lower())]
    if not parts:
        return F.lit(False)
    low = F.lower(c)
    return reduce(and_, [F.contains(low, F.lit(p)) & low.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){re.escape(p)}") for p in parts])


def value_forms(value: str) -> list[str]:
    """Spellings of an identifier: a UUID with and without dashes."""
    v = value.strip()
    bare = v.replace("-", "")
    if re.fullmatch(r"[0-9a-fA-F]{32}", bare):
        dashed = "-".join((bare[:8], bare[8:12], bare[12:16], bare[16:20], bare[20:]))
        return list(dict.fromkeys((v, bare.lower(), dashed.lower())))
    return [v]


def matches(query: str, text_fields: list[str], id_fields: list[str] = ()) -> Column:
    """Rows that the query finds in a text field, or whose id it is. A query without a usable keyword finds nothing."""
    out = [has_keywords(F.col(f), query) & phrase(F.col(f), query) for f in text_fields] if keywords(query) else []
    if len(query.split()) == 1:
        out += [F.col(f).cast("string").isin(value_forms(query)) for f in id_fields]
    return F.coalesce(reduce(or_, out), F.lit(False)) if out else F.lit(False)


# What can be searched by name: columns that hold prose, and columns that hold identifiers.
FIELDS = {
    "text": (("text",), ()),
    "author": (("author", "vanity", "posting_author", "posting_vanity"), ("author_id", "posting_author_id")),
    "network": (("network",), ()),
    "uuid": ((), ("uuid", "posting_uuid")),
}


def by_field(df: DataFrame, field: str, query: str) -> DataFrame:
    """Rows that the query finds in a field of FIELDS; columns that df lacks hold nothing. ValueError for other fields."""
    if field not in FIELDS:
        raise ValueError(f"no field {field}")
    texts, ids = ([c for c in columns if c in df.columns] for columns in FIELDS[field])
    return find(df, query, texts, ids)


def total(found: DataFrame, query: str) -> DataFrame:
    """How many rows the query finds; null for a phrase, whose hits an index alone can't tell."""
    if len(query.split()) > 1:
        return found.limit(0).agg(F.sum(F.lit(1)).alias("total"))
    return found.agg(F.count(F.lit(1)).alias("total"))


def narrowed(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition, or all if none does."""
    hit = df.where(condition)
    return df if hit.isEmpty() else hit


def not_coarse(df: DataFrame) -> Column:
    return F.coalesce(F.col("hier_type"), F.lit("")) != "coarse" if "hier_type" in df.columns else F.lit(True)


def find(chunks: DataFrame, query: str, text_fields: list[str] = ("text",), id_fields: list[str] = ()) -> DataFrame:
    return chunks.where(not_coarse(chunks) & matches(query, list(text_fields), list(id_fields)))


def hits(found: DataFrame) -> DataFrame:
    """How hits are shown: a preview of 600 characters, whether it is cut, and an estimate of tokens."""
    return found.select("node_id", "filename", t.preview(F.col("text")).alias("preview"), (F.length("text") > 600).alias("truncated"), t.estimated_tokens(F.col("text")).alias("est_tokens"))


def encode_cursor(after: str | int, **extra: object) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "after": after, **extra}).encode()).decode().rstrip("=")


def decode_cursor(token: str) -> dict:
    """ValueError for anything that encode_cursor didn't make."""
    try:
        got = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except (ValueError, UnicodeDecodeError) as e:
        raise ValueError("bad cursor") from e
    if not isinstance(got, dict) or got.get("v") != 1:
        raise ValueError("bad cursor")
    return got


def page(df: DataFrame, key: str, limit: int, cursor: str | None = None) -> DataFrame:
    """The next rows behind a cursor by key: a range filter and a limit, so that no page costs more than the first."""
    if cursor:
        df = df.where(F.col(key) > F.lit(decode_cursor(cursor)["after"]))
    return df.orderBy(key).limit(limit)


def write_csv(df: DataFrame, path: str) -> None:
    """An export as CSV part files with headers; RFC 4180 quotes, lists joined by semicolons, nulls empty."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    df.select(*[t.csv_cell(F.col(f"`{c}`"), c in arrays).alias(c) for c in df.columns]).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
