"""Temporal URL lists: every capture against the list entries that were active when it was fetched.

Dated entries (add or remove a host or domain) become validity intervals: an entry holds from its date
to the next entry of the same list and key (null: for ever). The as-of join is an equi-join on key and cell of time, with the
interval's ends as a condition: an interval lies in the minute, else the hour, that holds it whole, else it is laid out
over the spans of 30 days that it touches. A capture asks one cell of each width, and meets there the intervals of its minute and
at most one for each list and minute of its hour, or hour of its 30 days, however many entries a key has. A host with very many
captures stays splittable, as the captures' side of the join needs no grouping. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host(url: Column) -> Column:
    """Lower-case host without user, port and a trailing dot; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.rtrim(h, F.lit(".")), F.lit(""))


def domains(h: Column) -> Column:
    """The host and every domain above it of two labels or more; a host of one label is itself."""
    parts = F.split(h, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(h.isNotNull(), F.array_distinct(tails))


WIDTHS = (60, 3600, 30 * 86400)  #: seconds of a cell


def cell(t: Column, width: int) -> Column:
    return F.struct(F.lit(width).alias("width"), F.floor(F.unix_seconds(t) / width).alias("number"))


def cells(start: Column, end: Column) -> Column:
    """The narrowest cell that holds both times; the widest ones that they touch, if none does."""
    inside = [F.when(cell(start, w) == cell(end, w), F.array(cell(start, w))) for w in WIDTHS[:-1]]
    numbers = F.sequence(cell(start, WIDTHS[-1])["number"], cell(end, WIDTHS[-1])["number"])
    return F.coalesce(*inside, F.transform(numbers, lambda n: F.struct(F.lit(WIDTHS[-1]).alias("width"), n.alias("number"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, key, action, weight, valid_from, valid_to) of entries (list_name, key, action, weight, effective).

    Of entries of one list, key and time the one with the greatest action, then weight, holds. Entries without
    key or time are none; 'remove' ends the entry before and holds nothing.
    """
    e = entries.select("list_name", F.lower("key").alias("key"), "action", "weight", F.col("effective").cast("timestamp").alias("valid_from"))
    e = e.where("list_name is not null and key is not null and valid_from is not null and action is not null")
    e = e.groupBy("list_name", "key", "valid_from").agg(F.max(F.struct("action", "weight")).alias("last"))
    e = e.select("list_name", "key", "valid_from", "last.action", "last.weight", F.to_date("valid_from").alias("day"))
    # a key with a long history is ordered day by day, and only the days' first entries all together
    firsts = e.groupBy("list_name", "key", "day").agg(F.min("valid_from").alias("first"))
    firsts = firsts.select("list_name", "key", "day", F.lead("first").over(Window.partitionBy("list_name", "key").orderBy("day")).alias("after"))
    inside = Window.partitionBy("list_name", "key", "day").orderBy("valid_from")
    e = e.withColumn("next", F.lead("valid_from").over(inside)).join(firsts, ["list_name", "key", "day"])
    return e.where("action <> 'remove'").select("list_name", "key", "action", "weight", "valid_from", F.coalesce("next", "after").alias("valid_to"))


def as_of(captures: DataFrame, entries: DataFrame, id_column: str = "page_id", url: str = "url", time: str = "fetched") -> DataFrame:
    """Every capture with its matches.

    id_column, host, n_lists, lists (sorted, joined by commas), allowed, blocked, decision. A capture is blocked if a block
    entry of its host or of a domain above it is active, unless an allow entry is. Captures without url,
    host or time match nothing. Rows with equal id, url and time are one capture.
    """
    c = captures.select(F.col(id_column), F.col(url).alias("__url"), F.col(time).cast("timestamp").alias("__at")).withColumn("host", host(F.col("__url")))
    keyed = c.where("host is not null and __at is not null").withColumn("key", F.explode(domains(F.col("host"))))
    held = intervals(entries).drop("weight")
    ended = held.where("valid_to is not null").withColumn("cell", F.explode(cells(F.col("valid_from"), F.col("valid_to"))))
    asked = keyed.withColumn("cell", F.explode(F.array(*[cell(F.col("__at"), w) for w in WIDTHS])))
    hit = asked.join(ended, ["key", "cell"]).where("valid_from <= __at and __at < valid_to").drop("cell", "valid_to")
    still = keyed.join(held.where("valid_to is null").drop("valid_to"), "key").where("valid_from <= __at")  # one for each list and key at most
    cols = [id_column, "__url", "__at", "host", "list_name", "action"]
    none = F.lit(None).cast("string")
    rows = c.withColumns({"list_name": none, "action": none}).select(cols).union(hit.select(cols)).union(still.select(cols))
    n = rows.groupBy(id_column, "__url", "__at", "host").agg(
        F.sort_array(F.collect_set("list_name")).alias("lists"),
        F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)).alias("allowed"),
        F.coalesce(F.bool_or(F.col("action") == "block"), F.lit(False)).alias("blocked"),
    )
    return n.select(
        id_column, "host", F.size("lists").cast("long").alias("n_lists"), F.array_join("lists", ",").alias("lists"), "allowed", "blocked",
        F.when(F.col("blocked") & ~F.col("allowed"), "drop").otherwise("keep").alias("decision"),
    )
