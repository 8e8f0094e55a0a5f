"""Dense, sparse and hybrid retrieval, re-ranking and greedy selection.

Blocks of rows are scored against blocks of queries, and a task keeps k rows of every query before any is sent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import nearness
from .kept import keep


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(rows: DataFrame, queries: DataFrame, k: int, same: str | None = None, threshold: float | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): each query's k rows with the greatest cosine, its own id left out; ties to smaller ids.

    Blocks of rows meet blocks of queries as matrix products, and a task keeps k rows of each of its queries. ``same``: only
    rows with the query's value of this column, whose groups of any size are cut into blocks, too. ``threshold``: the least cosine.
    Vectors that are null or of no length take no part. Ids must be distinct.
    """
    g = F.to_json(F.struct(same)) if same else F.lit("")
    cols = [g.alias("g"), F.col("vec_id").alias("pos"), F.col("embedding").alias("v")]
    long = F.exists("v", lambda x: x != 0)

    def best(asked: np.ndarray, ids: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
        s = nearness.rounded(s, 6)
        s[asked[:, None] == ids] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(s, order, 1)
        use = np.isfinite(top) if threshold is None else top >= threshold
        return {"query_id": np.repeat(asked, use.sum(1)), "vec_id": ids[order[use]], "score": top[use]}

    met = nearness.meet(queries.select(*cols).where(long), rows.select(*cols).where(long), best, "query_id long, vec_id long, score double")
    return top_k(met, k)


def top_k(scored: DataFrame, k: int, by: str = "query_id", key: str = "vec_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def words(texts: DataFrame, *by: str, column: str = "text", among: DataFrame | None = None) -> DataFrame:
    """(by, token), a row for each place; with ``among``, which is broadcast, of its tokens only."""
    each = texts.select(*by, F.explode(F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x).between(2, 30))).alias("token"))
    return each if among is None else each.join(F.broadcast(among), "token", "left_semi")


def counted(each: DataFrame, *by: str) -> DataFrame:
    return each.groupBy(*by, "token").agg((1 + F.log(F.count(F.lit(1)).cast("double"))).alias("weight"))


def term_weights(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, token, weight): 1 + log(count) of tokens."""
    return counted(words(texts, key, column=column), key)


def sparse_scores(rows: DataFrame, queries: DataFrame, key: str, query_key: str) -> DataFrame:
    """Sums of products of weights over shared tokens. Only tokens of queries pass the first join."""
    both = rows.join(queries.select(query_key, "token", F.col("weight").alias("qw")), "token")
    return both.groupBy(query_key, key).agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score"))


ROWS, BYTES, QUERIES, CELLS = 2048, 8_000_000, 512, 4_000_000  #: texts of a block, and their bytes together; its queries; numbers of a matrix
COPIES = 500_000  #: rows of queries that a task copies to blocks


def sparse_top(texts: DataFrame, queries: DataFrame, k: int, key: str, query_key: str) -> DataFrame:
    """(query_key, key, score, rank): each query's k texts with the greatest sparse score, ties to smaller keys.

    Blocks of texts meet blocks of queries as matrix products, and a task sends k texts of each of its queries only: pairs of
    a text and a query are never rows. A task has one block, of so many texts and bytes whatever the table's size. Texts without
    a token of the query are no hits.
    """
    q = keep(term_weights(queries, query_key))
    tokens, have = q.select("token").distinct(), texts.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    down, across = max(1, -(-have.rows // ROWS), -(-(have.bytes or 0) // BYTES)), max(1, -(-queries.count() // QUERIES))
    n = down * across  # blocks, and partitions: block b goes to partition b, as a hash of it would give some tasks many blocks
    i, j = (F.pmod(F.xxhash64(c), F.lit(m)).cast("int") for c, m in ((key, down), (query_key, across)))
    # Whole texts cross the network, not their words: a shuffle to many partitions holds what a task writes in memory.
    dealt = texts.select(key, "text", F.explode(F.sequence(i * across, i * across + across - 1)).alias("b")).repartitionById(n, "b")
    d = counted(words(dealt, "b", key, among=tokens if tokens.count() <= nearness.GROUPS else None), "b", key)
    q = q.repartition(max(1, -(-q.count() * down // COPIES))).withColumn("b", F.explode(F.sequence(j, F.lit(n - 1), F.lit(across)))).repartitionById(n, "b")
    names = [query_key, key, "score"]

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        tokens, asked = pd.factorize(y.token), np.unique(y[query_key], return_inverse=True)
        x = x.assign(t=pd.Index(tokens[1]).get_indexer(x.token))
        x = x[x.t >= 0]
        ids, at = np.unique(x[key], return_inverse=True)
        weights = np.zeros((len(tokens[1]), len(asked[0])))
        weights[tokens[0], asked[1]] = y.weight
        step, out = max(1, CELLS // max(1, len(tokens[1]))), [pd.DataFrame({c: [] for c in names})]
        order = np.argsort(at, kind="stable")
        at, t, w = at[order], x.t.to_numpy()[order], x.weight.to_numpy()[order]
        for a in range(0, len(ids), step):
            own = slice(*np.searchsorted(at, [a, a + step]))
            m = np.zeros((min(step, len(ids) - a), len(tokens[1])))
            m[at[own] - a, t[own]] = w[own]
            s = np.round(m @ weights, 6).T
            first = np.argsort(-s, axis=1, kind="stable")[:, :k]
            top = np.take_along_axis(s, first, 1)
            use = top > 0
            out.append(pd.DataFrame(dict(zip(names, (np.repeat(asked[0], use.sum(1)), ids[a:][first[use]], top[use])))))
        return pd.concat(out[1:] or out)

    kinds = [f"{query_key} {queries.schema[query_key].dataType.simpleString()}", f"{key} {texts.schema[key].dataType.simpleString()}", "score double"]
    met = d.groupBy("b").cogroup(q.groupBy("b")).applyInPandas(best, ", ".join(kinds))
    return top_k(met, k, query_key, key)


def scaled(lane: DataFrame, name: str, by: str) -> DataFrame:
    """Min-max scores of each query's own list; a constant list is 1."""
    w = Window.partitionBy(by)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return lane.withColumn(name, F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo))).drop("score", "rank")


def fuse(dense: DataFrame, sparse: DataFrame, by: str, key: str, alpha: float = 0.5, k: int = 20) -> DataFrame:
    """Weighted sum of both lanes' scaled scores; what one lane lacks counts 0. Ties by key."""
    d, s = scaled(dense, "d", by).select(by, key, "d"), scaled(sparse, "s", by).select(by, key, "s")
    both = d.join(s, [by, key], "full_outer")
    total = F.round(alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0)), 6)
    return top_k(both.select(by, key, total.alias("score")), k, by, key)


def rerank(hits: DataFrame, score: Column, keep: int, floor: float | None = None, floored: Column | None = None) -> DataFrame:
    """Score anew and keep the best of each query. Of rows that ``floored`` marks those under the floor go, if any row has a score at all."""
    out = hits.withColumn("rerank", F.round(score, 6))
    if floor is not None:
        scored = F.max(F.col("rerank").isNotNull()).over(Window.partitionBy("query_id"))
        out = out.withColumn("any", scored).where(~F.col("any") | ~floored | (F.coalesce("rerank", F.lit(0.0)) >= floor)).drop("any")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), "rank", "vec_id"))
    return out.withColumn("rerank_rank", rank).where(F.col("rerank_rank") <= keep)


def mmr(candidates: DataFrame, k: int, trade: float = 0.5) -> DataFrame:
    """Maximal marginal relevance: greedy picks of each query's bounded list (query_id, vec_id, embedding, score)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(pdf.embedding.to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        chosen: list[int] = []
        near = np.full(len(pdf), -np.inf)
        while len(chosen) < min(k, len(pdf)):
            gain = trade * pdf.score.to_numpy() - (1 - trade) * np.where(np.isinf(near), 0, near)
            gain[chosen] = -np.inf
            i = int(np.argmax(np.round(gain, 9)))
            chosen.append(i)
            near = np.maximum(near, x @ x[i])
        out = pdf.iloc[chosen][["query_id", "vec_id", "score"]].copy()
        out["pick"] = np.arange(1, len(out) + 1)
        return out

    return candidates.select("query_id", "vec_id", "embedding", "score").groupBy("query_id").applyInPandas(pick, "query_id long, vec_id long, score double, pick int")


def prune_near(rows: DataFrame, by: str, threshold: float = 0.95) -> DataFrame:
    """Greedy pruning within sets of any size: a row stays if no kept row before it (by vec_id) is as near as the threshold."""
    r = rows.select(by, "vec_id", F.col("embedding").alias("v"), F.to_json(F.struct(by)).alias("g"))
    r = nearness.numbered(r, [F.col("g"), F.col("vec_id")])
    return r.join(nearness.independent(r, threshold).select("pos"), "pos", "left_semi").select(by, "vec_id")


def candidates(rows: DataFrame, stored: DataFrame, block: str, threshold: float = 0.86, k: int = 5) -> DataFrame:
    """Stored rows of the same block with a cosine of the threshold or more, k at most for each row."""
    return nearest(stored, rows, k, block, threshold)
