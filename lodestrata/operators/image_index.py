"""Vectors of images stored by coarse cells, so that a search reads the cells that its queries probe only.

Cells are those of centroids, fitted by a few rounds of k-means on a bounded sample; every row is stored. The folder has
``rows`` (vec_id, embedding) in folders by cell, and ``cells`` (cell, centroid, n).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nearness, plugs, vectors

SAMPLE, ROUNDS = 20_000, 8  #: rows that cells are fitted on, at most, and rounds of k-means
LEAST_CELLS, MOST_CELLS = 8, 1024  #: between these there are about as many as the root of the rows
ROWS = "vec_id long, embedding array<double>"


class Index(NamedTuple):
    spark: SparkSession
    path: str
    centroids: np.ndarray  #: of unit length, one for each cell


def fit(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids by spherical k-means from evenly spread rows; cells that come out empty keep their centroid."""
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), c)
    return np.unique(c, axis=0)


def build(rows: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Store rows (vec_id, embedding) under a new path. Vectors that are null or of no length are left out."""
    spark = rows.sparkSession
    own = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.exists("embedding", lambda x: x != 0))
    cells = cells or min(max(LEAST_CELLS, int(own.count() ** 0.5)), MOST_CELLS)
    chosen = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    c = fit(nearness.units(chosen.embedding), cells) if len(chosen) else np.zeros((0, 1))

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series((nearness.units(v) @ c.T).argmax(1).astype(np.int32))

    own.withColumn("cell", cell("embedding")).repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
    n = spark.read.schema(f"{ROWS}, cell int").parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    made = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cell int, centroid array<double>")
    made.join(n, "cell", "left").na.fill(0, ["n"]).coalesce(1).write.parquet(f"{path}/cells")
    return Index(spark, path, c)


def load(spark: SparkSession, path: str) -> Index:
    made = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()
    return Index(spark, path, np.stack(made.centroid.to_numpy()) if len(made) else np.zeros((0, 1)))


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): the k most similar rows in the cells nearest to each query, its own id left out.

    ``probes`` is how many cells, a third of all unless given. With ``exact`` all of them are read, and the result is that of all
    rows. Only the folders of probed cells are opened.
    """
    c, exact = index.centroids, exact or not len(index.centroids)
    stored = index.spark.read.schema(f"{ROWS}, cell int").parquet(f"{index.path}/rows")
    q = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.exists("embedding", lambda x: x != 0))
    if exact:
        return vectors.nearest(stored, q, k)
    n = min(probes or -(-len(c) // 3), len(c))

    @F.pandas_udf("array<int>")
    def nearest_cells(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.argsort(-(nearness.units(v) @ c.T), axis=1, kind="stable")[:, :n].astype(np.int32)))

    asked = nearness.keep(q.select("vec_id", "embedding", F.explode(nearest_cells("embedding")).alias("cell")))
    at = [r.cell for r in asked.select("cell").distinct().collect()]  # numbers of cells
    return vectors.nearest(stored.where(F.col("cell").isin(at)), asked, k, "cell")


def search_texts(index: Index, texts: DataFrame, embed: plugs.Plug, k: int, **how) -> tuple[DataFrame, DataFrame]:
    """(hits, failed): images by texts (vec_id, text), whose vectors a plug makes; texts that it fails on are told apart."""
    good, failed = plugs.split(plugs.enrich(texts.select("vec_id", "text"), ["text"], embed, "embedding"))
    return search(index, good, k, **how), failed.select("vec_id", "text", "error")


def payloads(hits: DataFrame, images: DataFrame, floor: float = 0.0) -> DataFrame:
    """Hits at the floor or over it with what is known of their images (vec_id, ...); hits without an image row go."""
    return hits.where(F.col("score") >= floor).join(images, "vec_id")
