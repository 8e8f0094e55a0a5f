"""Greedy choices by nearness in Spark rounds: no group of rows, however large, is one task's work.

Rows are (g, pos, v): a group, a place in the order (unique over all groups) and a vector. Vectors meet in pairs of
blocks of a group, of so many rows that there are some TASKS such pairs: a smaller side is copied to the blocks of a larger one,
and copies don't grow with the rows until blocks have MOST of them. The choice goes over growing prefixes of the order, and what lies near a chosen row leaves
before the next prefix, so that only near pairs within a prefix are ever written down.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kept import keep

FEW, MOST, TASKS = 512, 16384, 48  #: rows in a block, at least and at most, and pairs of blocks if these allow
CELLS = 4_000_000  #: numbers of a matrix of cosines
HALVES = 12
GROUPS = 2_000_000  #: whose sizes are broadcast


def of_group(rows: DataFrame, facts: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(facts) if facts.count() <= GROUPS else facts, "g")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with ``pos``, by a sort of the whole table (no group's rows need to fit one task)."""
    return keep(rows.orderBy(*order).withColumn("pos", F.monotonically_increasing_id()))


def units(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def first_copies(rows: DataFrame, threshold: float) -> DataFrame:
    """The first row of equal vectors: a later copy is near the first one, or near what the first one is near. Vectors of no length stay."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    alone = F.when((length < 1e-12) | F.lit(threshold > 1 - 1e-9), F.col("pos"))
    return rows.groupBy("g", "v", alone.alias("alone")).agg(F.min("pos").alias("pos")).select("g", "pos", "v")


def meet(a: DataFrame, b: DataFrame, match: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """match() of rows of a with every block of b in the same group, one task's work each pair of blocks.

    match: from places of some rows of a, places of b's block in their order, and the cosines between both, to columns. It sees as many
    rows of a at a time as CELLS allow.
    """

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("g").agg(F.count(F.lit(1)).alias(name))

    sizes = keep(rows(a, "na").join(rows(b, "nb"), "g"))
    of_all = sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("pairs")).first()
    most = int(min(max(((of_all.pairs or 0) / TASKS) ** 0.5, FEW), MOST))
    sizes = sizes.select("g", *(F.ceil(F.col(n) / most).cast("int").alias(n) for n in ("na", "nb")))
    sizes = F.broadcast(sizes) if of_all.groups <= GROUPS else sizes

    def side(df: DataFrame, first: bool) -> DataFrame:
        own, other = ("na", "nb") if first else ("nb", "na")
        at, all_of = F.pmod(F.xxhash64("pos"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return df.join(sizes, "g").select("g", "pos", "v", F.lit(first).alias("first"), *((at.alias("i"), all_of.alias("j")) if first else (all_of.alias("i"), at.alias("j"))))

    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["first"]], pdf[~pdf["first"]].sort_values("pos")
        out = [pd.DataFrame({c: [] for c in names})]
        if len(x) and len(y):
            p, u, q, w = x.pos.to_numpy(), units(x.v), y.pos.to_numpy(), units(y.v).T
            step = max(1, CELLS // len(y))
            out += [pd.DataFrame(match(p[i : i + step], q, u[i : i + step] @ w)) for i in range(0, len(x), step)]
        return pd.concat(out[1:] or out)

    return side(a, True).unionByName(side(b, False)).groupBy("g", "i", "j").applyInPandas(run, schema)


def rounded(s: np.ndarray, digits: int | None) -> np.ndarray:
    return s if digits is None else np.round(s, digits)


def near(s: np.ndarray, threshold: float, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the numbers that, rounded to ``digits``, are the threshold or more."""
    i, j = np.divmod(np.flatnonzero(s >= threshold - (0 if digits is None else 10.0**-digits)), max(1, s.shape[1]))
    v = rounded(s[i, j], digits)
    use = v >= threshold
    return i[use], j[use], v[use]


def settle(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """pos of the rows that have no chosen earlier neighbour. edges: (later, earlier), all near pairs of rows."""
    out, left = [], keep(rows.select("pos"))
    while not left.isEmpty():
        chosen = keep(left.join(edges.select(F.col("later").alias("pos")), "pos", "left_anti"))
        out.append(chosen)
        gone = keep(edges.join(chosen.select(F.col("pos").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("pos")).distinct())
        left = keep(left.join(chosen, "pos", "left_anti").join(gone, "pos", "left_anti"))
        for end in ("later", "earlier"):
            edges = edges.join(left.select(F.col("pos").alias(end)), end, "left_semi")
        edges = keep(edges.select("later", "earlier"))
    return reduce(DataFrame.unionByName, out) if out else left


def independent(rows: DataFrame, threshold: float, digits: int | None = None, first: int = 1024) -> DataFrame:
    """The rows of a kept table that have no chosen row of their group before them whose cosine (rounded to ``digits``) is the threshold or more.

    The first prefix has about ``first`` rows of a group, each further one twice as many.
    """

    def pairs(p: np.ndarray, q: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
        i, j, _ = near(s, threshold, digits)
        use = p[i] > q[j]
        return {"later": p[i[use]], "earlier": q[j[use]]}

    def reached(p: np.ndarray, q: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
        return {"pos": p[np.unique(near(s, threshold, digits)[0])]}

    out, left, size = [], keep(first_copies(rows, threshold)), first
    while not left.isEmpty():
        n = left.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"), F.percentile_approx("pos", [0.5**k for k in range(HALVES + 1)], 10000).alias("at"))
        halves = F.least(F.ceil(F.log2(F.col("n") / size)), F.lit(HALVES)).cast("int")
        cut = keep(n.select("g", F.when(F.col("n") <= size, F.col("last")).otherwise(F.element_at("at", F.greatest(halves, F.lit(0)) + 1)).alias("cut")))
        prefix = keep(of_group(left, cut).where("pos <= cut").select("g", "pos", "v"))
        chosen = keep(prefix.join(settle(prefix, keep(meet(prefix, prefix, pairs, "later long, earlier long"))), "pos", "left_semi").select("g", "pos", "v"))
        out.append(chosen)
        rest = keep(of_group(left, cut).where("pos > cut").select("g", "pos", "v"))
        left = rest if rest.isEmpty() else keep(rest.join(meet(rest, chosen, reached, "pos long").distinct(), "pos", "left_anti").select("g", "pos", "v"))
        size *= 2
    return reduce(DataFrame.unionByName, out) if out else left


def nearest_before(rows: DataFrame, chosen: DataFrame, digits: int) -> DataFrame:
    """(pos, to, similarity): for each row the nearest chosen row of its group before it, the first of equally near ones."""

    def best(p: np.ndarray, q: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
        s = np.where(p[:, None] > q, rounded(s, digits), -np.inf)
        at = s.argmax(axis=1)
        top = s[np.arange(len(p)), at]
        use = np.isfinite(top)
        return {"pos": p[use], "to": q[at[use]], "similarity": top[use]}

    found = meet(rows, chosen, best, "pos long, to long, similarity double")
    top = found.groupBy("pos").agg(F.max(F.struct("similarity", (-F.col("to")).alias("minus"))).alias("top"))
    return top.select("pos", (-F.col("top.minus")).alias("to"), F.col("top.similarity").alias("similarity"))
