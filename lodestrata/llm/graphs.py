"""Connected components as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def components(edges: DataFrame) -> DataFrame:
    """(v, c): every vertex of edges (a, b) and the smallest vertex that it is connected with.

    A vertex takes the least label of its neighbours and then its label's label, until nothing changes: the
    number of rounds goes with the logarithm of the longest path. No group of neighbours is gathered anywhere.
    """
    both = keep(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    labels = keep(both.groupBy("v").agg(F.min("u").alias("least")).select("v", F.least("v", "least").alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("near"))
        new = labels.join(near, "v", "left").select("v", F.least("c", F.coalesce("near", "c")).alias("to"), "c")
        up = labels.select(F.col("v").alias("to"), F.col("c").alias("above"))
        new = keep(new.join(up, "to", "left").select("v", F.least("to", F.coalesce("above", "to")).alias("c"), F.col("c").alias("old")), "labels")
        done = not new.where("c <> old").take(1)
        discard(labels)
        labels = new.drop("old")
        labels._kept_at = new._kept_at
        if done:
            discard(both)
            return labels
