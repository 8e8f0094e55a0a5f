"""Exact top-k by inner product as a Voronoi join.

Rows and queries belong to the cell of their nearest pivot. A cell's summary (radius, and the distances
of the few rows nearest to its pivot) bounds the product of a query q with any of its rows x: it differs
from q.p by |q| |x - p| at most. So each query knows a score that its k-th best can't fall below, and the
cells that can reach it; a cell's rows are sent only to the query groups that need it. Groups are solved
in slots of rows, whose best k are merged per query. A slot holds some neighbouring small cells or a share of
a large one, and a query goes to the slots of the cells that it needs only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, keep, tidied

LEAST_PIVOTS, MOST_PIVOTS = 64, 1024  #: between these there are about as many as the root of the rows
QUERY_BLOCK, ROW_BLOCK = 512, 16384  #: at most about so many meet in one task
BOUND_BLOCK = 128  #: queries whose bounds are computed at once


def scaled(embedding: Column, factor: float = 1024.0) -> Column:
    """floor(factor * x) of every component, as longs; null for vectors that are null, empty or hold null or non-finite components. An integer beyond 64 bits is an error."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    long = lambda x: F.when(F.abs(x) < 2.0**63, F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("a scaled component needs more than 64 bits")))
    return F.when((F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(embedding, lambda x: long(F.lit(factor) * x.cast("double"))))


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, ended by zeros where short."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat, offs = col.flatten().to_numpy(), col.offsets.to_numpy()
    size = np.diff(offs)
    if len(size) and (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims), np.int64)
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], size)] = flat
    return out


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row (ties: the first) and the distance to it."""
    d = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)
    cell = d.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of each query's k best rows, its own left out; ties to smaller ids. ids go up."""
    most = np.sqrt((q.astype(float) ** 2).sum(1).max(initial=0)) * np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0))
    if most < 2**52:
        s = np.rint(q.astype(float) @ x.T.astype(float)).astype(np.int64)
    else:  # Python's integers where a sum may leave 64 bits
        s = q @ x.T if most < 2**62 else q.astype(object) @ x.T.astype(object)
    own = q_ids[:, None] == ids[None]
    s[own] = -(1 << 63) if s.dtype != object else -(1 << 200)
    out = []
    for i in range(len(q)):
        row = s[i]
        if len(row) > k:
            cut = np.partition(row, len(row) - k)[len(row) - k]
            over = np.flatnonzero(row > cut)
            take = np.r_[over, np.flatnonzero(row == cut)[: k - len(over)]]
        else:
            take = np.arange(len(row))
        take = take[~own[i, take]]
        out.append((np.full(len(take), q_ids[i]), ids[take], row[take]))
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ())))


def slots(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot of each cell and how many it is dealt over, for the cells' numbers of rows in order.

    Small neighbours share a slot; no slot gets more than about twice ``size`` rows.
    """
    ends = np.cumsum(rows)
    first = (ends - rows) // size
    return first, np.maximum((ends - 1) // size - first + 1, 1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows with the greatest inner product, all if there are fewer.

    vectors and queries: (vec_id long, v array<long>); null vectors and ids take no part. A query is an id: of rows
    that repeat it the least vector asks, once. All rows with its id are its own and no results, however many; rows of another
    id are results one by one, also equal ones. Vectors of different lengths are ended by zeros. Either table may be
    empty. A result's score beyond 64 bits is an error, as it can't be returned. Other columns aren't looked at.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = keep(vectors.select("vec_id", "v").where("vec_id is not null and v is not null"), "vectors")
    asked = queries.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    own = rows.join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").agg(F.count(F.lit(1)).alias("own"))
    asked = keep(asked.join(own, "vec_id", "left").select("vec_id", "v", F.coalesce("own", F.lit(0)).alias("own")), "asked")
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_asked, wide = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or not n_asked:
        return empty
    dims = max(dims, wide)
    pivots = pivots or min(max(LEAST_PIVOTS, int(n**0.5)), MOST_PIVOTS)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toArrow()
    p = np.unique(matrix(chosen.column("v"), dims), axis=0).astype(float)
    groups = max(1, -(-n_asked // QUERY_BLOCK))
    group_of = nearest(p, p[:: max(1, -(-len(p) // groups))])[0]  # cells of like pivots share a query group

    @tidied
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, d = nearest(matrix(b.column(1), dims).astype(float), p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d)], names=["vec_id", "v", "cell", "distance"])

    celled = keep(rows.mapInArrow(assign, "vec_id long, v array<long>, cell int, distance double"), "cells")

    @tidied
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, np.ndarray] = {}
        far: dict[int, float] = {}
        many: dict[int, int] = {}
        for b in batches:
            cell, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                own = np.sort(d[cell == c])
                near[c] = np.sort(np.r_[near.get(c, own[:0]), own[: k + 1]])[: k + 1]
                far[c] = max(far.get(c, 0.0), float(own[-1]))
                many[c] = many.get(c, 0) + len(own)
        columns = pa.array(list(near), pa.int32()), pa.array([x.tolist() for x in near.values()], pa.list_(pa.float64())), pa.array(list(far.values()), pa.float64()), pa.array(list(many.values()), pa.int64())
        yield pa.RecordBatch.from_arrays(list(columns), names=["cell", "near", "far", "many"])

    s = celled.select("cell", "distance").mapInArrow(summary, "cell int, near array<double>, far double, many long")
    each = s.select("cell", F.explode("near").alias("d")).withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("n") <= k + 1)
    each = each.groupBy("cell").agg(F.array_sort(F.collect_list("d")).alias("near"))
    s = s.groupBy("cell").agg(F.max("far").alias("far"), F.sum("many").alias("many")).join(each, "cell").collect()  # at most as many rows as pivots
    s.sort(key=lambda r: (group_of[r.cell], r.cell))
    cells = np.array([r.cell for r in s])
    radius = np.array([r.far for r in s])
    owner = np.concatenate([np.full(len(r.near), i) for i, r in enumerate(s)])
    near = np.concatenate([r.near for r in s])
    first_slot, n_slots = slots(np.array([r.many for r in s]), ROW_BLOCK)
    placed = spark.createDataFrame(list(zip(cells.tolist(), first_slot.tolist(), n_slots.tolist())), "cell int, first_slot long, n_slots long")

    @tidied
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = p[cells]
        length = np.sqrt((at**2).sum(1)) + radius + 1
        for whole in batches:
            for i in range(0, len(whole), BOUND_BLOCK):
                b = whole.slice(i, BOUND_BLOCK)
                q = matrix(b.column(1), dims).astype(float)
                norm = np.sqrt((q**2).sum(1))[:, None]
                dot = q @ at.T
                slack = 1e-9 * norm * length
                low = (dot - slack)[:, owner] - norm * near
                sure = np.full(len(q), -np.inf)
                own = b.column(2).to_numpy()
                for n_own in np.unique(own).tolist():  # so many of the rows behind the best bounds may be the query's own
                    at_, of = low.shape[1] - k - n_own, own == n_own
                    if at_ >= 0:
                        sure[of] = np.partition(low[of], at_, 1)[:, at_]
                need = dot + norm * radius + slack >= sure[:, None]
                home = group_of[nearest(q, p)[0]].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(home), pa.array([cells[x].tolist() for x in need], pa.list_(pa.int32()))], names=["vec_id", "v", "home", "needs"])

    bounded = keep(asked.mapInArrow(bound, "vec_id long, v array<long>, home int, needs array<int>"), "bounded")
    discard(rows, asked)
    per_group = bounded.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    blocked = bounded.join(F.broadcast(per_group) if groups <= 10_000 else per_group, "home")
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    asks = blocked.select(F.col("home").alias("g"), F.col("block").alias("b"), "vec_id", F.explode("needs").alias("cell")).join(F.broadcast(placed), "cell")
    need = asks.select("g", "b", "cell").distinct()
    slot = F.col("first_slot") + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("n_slots"))
    sent = celled.join(F.broadcast(placed), "cell").select("cell", slot.alias("slot"), "vec_id", "v").join(need, "cell").select("g", "b", "slot", "vec_id", "v")
    asks = asks.select("g", "b", "vec_id", F.explode(F.sequence("first_slot", F.col("first_slot") + F.col("n_slots") - 1)).alias("slot")).distinct()
    queries_sent = blocked.select(F.col("home").alias("g"), F.col("block").alias("b"), "vec_id", "v").join(asks, ["g", "b", "vec_id"])

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("vec_id")
        q = matrix(right.column("v"), dims), right.column("vec_id").to_numpy()
        got = best(*q, matrix(left.column("v"), dims), left.column("vec_id").to_numpy(), k)
        return pa.table([pa.array(c, pa.int64()) for c in got], names=["query_id", "vec_id", "score"])

    key = ["g", "b", "slot"]
    found = sent.groupBy(*key).cogroup(queries_sent.groupBy(*key)).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
