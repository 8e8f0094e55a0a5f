"""What happens to hits after retrieval, in this order: parents, diversity, links, numbers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kept import keep


def first_per_parent(hits: DataFrame, parent: str, order: list[Column]) -> DataFrame:
    """The best child of each parent; hits without a parent stay."""
    rank = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return hits.withColumn("__r", F.when(F.col(parent).isNull(), 1).otherwise(rank)).where("__r = 1").drop("__r")


def pack_parents(hits: DataFrame, budget: int) -> DataFrame:
    """Hits of each query (query_id, position, node_id, parent_id, parent_tokens, child_tokens) in order: a parent that fits stands for
    its first child, else the child stands alone; later children of a parent seen go. A query's hits are a bounded list."""

    parentless = hits.where("parent_id is null").select("query_id", "position", "node_id", F.lit("hit").alias("shown"))
    first = F.min(F.struct("position", "node_id", "parent_tokens", F.col("parent_id").cast("string").alias("parent"))).alias("x")
    firsts = hits.where("parent_id is not null").groupBy("query_id", "parent_id").agg(first)
    lists = firsts.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("l"))
    fits = lambda left, x: (left > 0) & F.coalesce(x["parent_tokens"] <= left, F.lit(False))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<boolean>").alias("whole"))

    def step(s: Column, x: Column) -> Column:
        whole = fits(s["left"], x)
        return F.struct(F.when(whole, s["left"] - x["parent_tokens"].cast("long")).otherwise(s["left"]).alias("left"), F.concat(s["whole"], F.array(whole)).alias("whole"))

    each = lists.select("query_id", F.inline(F.arrays_zip("l", F.aggregate("l", start, step)["whole"].alias("whole"))))
    shown = each.select(
        "query_id", "l.position", F.when(F.col("whole"), F.col("l.parent")).otherwise(F.col("l.node_id")).alias("node_id"), F.when(F.col("whole"), "parent").otherwise("child").alias("shown"),
    )
    kinds = {"query_id": "long", "position": "int", "node_id": "string", "shown": "string"}
    return parentless.unionByName(shown).select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))


def diverse(hits: DataFrame, identity: str, bucket: str, most: int, order: list[Column]) -> DataFrame:
    """The hits in order, without those whose identity was kept before, and without those whose bucket has ``most`` kept already.

    An identity that a full bucket turned away stays open and may enter with a later hit of another bucket. As a hit depends on
    earlier ones only, deciding all of them by the decisions of the round before, until none changes, ends at what one pass over
    the list would keep. A null identity repeats nothing. With ``bucket_rank``, the place among the kept of the bucket.
    """
    h = keep(hits.withColumn("__i", F.row_number().over(Window.partitionBy(identity).orderBy(*order))).withColumn("__kept", (F.col("__i") == 1) | F.col(identity).isNull()), "hits")
    before = lambda by: Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    while True:
        again = F.col(identity).isNotNull() & F.coalesce(F.max("__kept").over(before(identity)), F.lit(False))
        h = h.withColumn("__again", again)
        h = h.withColumn("__new", ~F.col("__again") & (F.coalesce(F.sum(F.when(F.col("__kept") & ~F.col("__again"), 1)).over(before(bucket)), F.lit(0)) < most))
        new = keep(h, "hits")
        changed = not new.where("__new <> __kept").isEmpty()
        h = new.withColumn("__kept", F.col("__new")).drop("__new", "__again")
        if not changed:
            break
    kept_ = h.where("__kept").drop("__kept", "__i")
    return kept_.withColumn("bucket_rank", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))


def follow_links(hits: DataFrame, siblings: DataFrame, key: str, node: str, most: int = 12) -> DataFrame:
    """Rows that share a key with a hit and are no hit themselves, ``most`` for each key by node."""
    keys = hits.select(key).distinct()
    new = siblings.join(keys, key, "left_semi").join(hits.select(key, node), [key, node], "left_anti")
    return new.withColumn("link_rank", F.row_number().over(Window.partitionBy(key).orderBy(node))).where(F.col("link_rank") <= most)


def numbered(hits: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return hits.withColumn("citation", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def scoped(ids: list[str], main: DataFrame, companion: DataFrame, key: str) -> DataFrame:
    """Rows of a list of ids in its order, from the main table, else its companion; ``found`` tells from which, or that it is missing."""
    spark = main.sparkSession
    want = spark.createDataFrame(list(enumerate(ids)), f"position int, {key} string")
    a = main.select(key, F.lit("main").alias("a")).join(F.broadcast(want), key, "left_semi").dropDuplicates([key])
    b = companion.select(key, F.lit("companion").alias("b")).join(F.broadcast(want), key, "left_semi").dropDuplicates([key])
    return want.join(a, key, "left").join(b, key, "left").select("position", key, F.coalesce("a", "b", F.lit("missing")).alias("found"))


def first_key_join(rows: DataFrame, keys: list[Column], index: DataFrame, index_key: str, value: str) -> DataFrame:
    """Join by several candidate keys in order of preference: one equi-join for each, none on a disjunction."""
    out = rows
    for i, k in enumerate(keys):
        side = index.select(F.col(index_key).cast("string").alias(f"__k{i}"), F.col(value).alias(f"__v{i}")).dropDuplicates([f"__k{i}"])
        out = out.withColumn("__k", k.cast("string")).join(side, F.col("__k") == F.col(f"__k{i}"), "left").drop("__k", f"__k{i}")
    return out.withColumn(value, F.coalesce(*[F.col(f"__v{i}") for i in range(len(keys))])).drop(*[f"__v{i}" for i in range(len(keys))])


def with_images(texts: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """Text hits, and those image hits whose image no text hit shows yet; ``lane`` tells them apart."""
    new = images.join(texts.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return texts.withColumn("lane", F.lit("text")).unionByName(new.withColumn("lane", F.lit("image")), allowMissingColumns=True)


def images_of(documents: DataFrame, images: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """At most ``most`` images (source_hash) of each document (file_hash), in this order."""
    own = images.join(documents.select(F.col("file_hash").alias("source_hash")).distinct(), "source_hash", "left_semi")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("source_hash").orderBy(*order))).where(F.col("place") <= most)


def texts_of(ids: DataFrame, main: DataFrame, companion: DataFrame, key: str) -> DataFrame:
    """The text of each id: that of the main lane, else, where it is blank, the companion's; null if neither has one."""
    a = main.select(key, F.col("text").alias("__a"))
    b = companion.select(key, F.col("text").alias("__b"))
    text = F.coalesce(F.when(F.col("__a").rlike(r"\S"), F.col("__a")), F.when(F.col("__b").rlike(r"\S"), F.col("__b")))
    return ids.join(a, key, "left").join(b, key, "left").select(key, text.alias("text"))


REACH = 80  #: characters within which an edge looks for white space


def window(parent: str | None, child: str | None, budget: int) -> str | None:
    """At most about ``budget`` characters of the parent around the child, cut at white space; the child's head where that alone is
    longer, null where the child isn't found. White space of any length counts as equal if the plain text isn't found."""
    if not parent or not child or budget <= 0:
        return None
    if len(child) >= budget:
        return child[:budget]
    at = parent.find(child)
    if at < 0:
        words = child.split()
        found = re.search(r"\s+".join(map(re.escape, words)), parent) if words else None
        if not found:
            return None
        at = found.start()
    half = (budget - len(child)) // 2
    start, end = max(0, at - half), min(len(parent), at + len(child) + half)
    if start and (blank := re.search(r"\s", parent[start : start + REACH])):
        start += blank.end()
    if end < len(parent) and (tail := re.search(r"\s\S*$", parent[max(start, end - REACH) : end])):
        end = max(start, end - REACH) + tail.start()
    return parent[start:end]


def parent_windows(hits: DataFrame, parent: str, child: str, budget: int) -> DataFrame:
    """hits with the ``window`` of their parent's text around their own."""

    @F.pandas_udf("string")
    def cut(p: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([window(x, y, budget) for x, y in zip(p, c)], dtype=object)

    return hits.withColumn("window", cut(F.col(parent), F.col(child)))
