"""Collections, their owners, ingest jobs and images as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

HIDDEN = r"_(images|dockv|entities)$"


def visible(names: DataFrame, column: str = "name") -> DataFrame:
    """Collections without those that only accompany another."""
    return names.where(~F.col(column).rlike(HIDDEN))


def owned(names: DataFrame) -> DataFrame:
    """(owner, logical, physical) of (owner, logical)."""
    return names.select("owner", "logical", t.physical_name(F.col("owner"), F.col("logical")).alias("physical")).dropDuplicates(["owner", "logical"])


def fold_jobs(events: DataFrame, most: int = 100) -> DataFrame:
    """Jobs of (job_id, at, kind, message): last progress, warnings (the first ``most``, and how many there were), state.

    A job whose last terminal event is the last of all is in that state, any other is running.
    """
    terminal = F.col("kind").isin("done", "error", "cancelled")
    first = F.row_number().over(Window.partitionBy("job_id", F.col("kind") == "warning").orderBy("at", "message"))
    e = events.withColumn("n", first)
    return e.groupBy("job_id").agg(
        F.max_by(F.when(F.col("kind") == "progress", t.progress_key(F.col("message"))), F.when(F.col("kind") == "progress", F.struct("at", "message"))).alias("last_progress"),
        F.count_if(F.col("kind") == "warning").alias("warnings"), F.count_if((F.col("kind") == "warning") & (F.col("n") <= most)).alias("warnings_kept"),
        F.coalesce(F.max_by(F.when(terminal, F.col("kind")), F.when(terminal, F.struct("at", "kind"))), F.lit("running")).alias("state"), F.max("at").alias("updated_at"),
    )


def newest(jobs: DataFrame, keep: int, by: str = "owner") -> DataFrame:
    """Finished jobs, the newest of each owner; those that run all stay."""
    rank = F.row_number().over(Window.partitionBy(by, F.col("state") == "running").orderBy(F.desc("updated_at"), "job_id"))
    return jobs.withColumn("rank", rank).where((F.col("state") == "running") | (F.col("rank") <= keep)).drop("rank")


def images(found: DataFrame) -> DataFrame:
    """Each content once, by its hash, with its places (sorted, each once)."""
    return found.groupBy(F.sha2("content", 256).alias("image_id")).agg(F.count(F.lit(1)).alias("found"), F.array_join(F.array_sort(F.collect_set("place")), ";").alias("places"))


def sparse_vectors(weights: DataFrame, key: str) -> DataFrame:
    """(key, indices, values) of (key, token_id, weight): the greatest weight of a token, positive and finite ones only, by token."""
    ok = (F.col("weight") > 0) & ~F.isnan("weight") & (F.col("weight") < float("inf"))
    best = weights.where(ok).groupBy(key, "token_id").agg(F.max("weight").alias("weight"))
    v = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("token_id", "weight"))).alias("v"))
    return v.select(key, F.col("v.token_id").alias("indices"), F.col("v.weight").alias("values"))


def upload_batches(files: DataFrame, by: str, most_bytes: int) -> DataFrame:
    """Files in batches under a size, by their order."""
    from .summary import windows

    return windows(files, by, "position", "bytes", most_bytes)


def highlighted(c, words: list[str]):
    """Text with marks around the tokens that begin with a keyword."""
    import re

    pattern = "|".join(re.escape(w.lower()) for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(c, rf"(?iU)(?<![\p{{L}}\p{{N}}_])((?:{pattern})[\p{{L}}\p{{N}}_]*)", "**$1**") if words else c


def owned_after(log: DataFrame, legacy: DataFrame | None = None, default_owner: str = "legacy") -> DataFrame:
    """(owner, logical, physical) after a log of (owner, logical, at, kind): ``claim`` sets, ``release`` deletes.

    legacy: (physical) names that nobody owns; they go to the default owner under their own name.
    """
    last = log.groupBy("owner", "logical").agg(F.max(F.struct("at", "kind")).alias("e")).where("e.kind = 'claim'")
    own = last.select("owner", "logical", t.physical_name(F.col("owner"), F.col("logical")).alias("physical"))
    if legacy is None:
        return own
    new = legacy.select("physical").distinct().join(own.select("physical"), "physical", "left_anti")
    return own.unionByName(new.select(F.lit(default_owner).alias("owner"), F.col("physical").alias("logical"), "physical"))


def by_name(owned_: DataFrame) -> DataFrame:
    """(typed, physical): every name under which exactly one collection is found, as typed physically or logically."""
    names = owned_.select(F.explode(F.array("physical", "logical")).alias("typed"), "physical").distinct()
    return names.groupBy("typed").agg(F.min("physical").alias("physical"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def active(jobs: DataFrame, by: str = "owner") -> DataFrame:
    """The latest unfinished job of each owner."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("updated_at"), "job_id"))
    return jobs.where("state = 'running'").withColumn("__n", rank).where("__n = 1").drop("__n")
