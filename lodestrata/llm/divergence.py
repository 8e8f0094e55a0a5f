"""How far the sources of a language differ in their terms, and by which terms each stands out.

Terms are counted by language and source in one pass over whole texts, tasks adding up what they meet. A
kept term is a row of its nonzero (source, share) items in the order of sources. Equal rows are one row with a
multiplicity, and rows that begin alike are nodes of one frequent-pattern tree: range-partitioned and sorted, a batch
of rows is a subtree, in which the correction of a pair of sources is made once for each node and ancestor
and counts for all rows below. What a pair owes to terms that one of both has not is a running sum over the
distinct shares of a source, so that no row is written out for sources that lack a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .common import discard, ids_join, keep, partitions, tidied

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
LETTERS = tb.table([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
FLUSH = 300_000  #: rows of counts that a task holds
CELLS = 2_000_000  #: items of rows in a task of trees, about


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, in as many rows for a term as tasks met it, about."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["g", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["g", "term", "n", "docs"])

        def rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
            names = list(groups)
            lang, source = (pa.array([x[i] for x in names]) for i in (0, 1))
            for b in t.combine_chunks().to_batches(max_chunksize=50_000):
                yield pa.RecordBatch.from_arrays([lang.take(b.column(0)), source.take(b.column(0)), b.column(1), b.column(2), b.column(3)], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for b in tb.blocks(batch, "text"):
                data, offs = tb.raw(b.column(2))
                of = np.array([groups.setdefault(x, len(groups)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
                words, at = tb.tokens(tb.LOWER[data], offs, LETTERS)
                if not len(words):
                    continue
                code, names = tb.coded(words)
                width = len(names)
                in_doc, n = np.unique(np.repeat(np.arange(len(of)), np.diff(at)) * width + code, return_counts=True)
                key, where = np.unique(of[in_doc // width] * width + in_doc % width, return_inverse=True)
                n_all = np.zeros(len(key), np.int64)
                np.add.at(n_all, where, n)
                held.append(pa.table({"g": key // width, "term": names.take(pa.array(key % width)), "n": n_all, "docs": np.bincount(where, minlength=len(key))}))
                if sum(t.num_rows for t in held) > FLUSH:
                    held[:] = [summed()]
                    if held[0].num_rows > FLUSH // 2:
                        yield from rows(held.pop())
        if held:
            yield from rows(summed())

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly: the product may need more than 64 bits."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.when(terms > 0, 1 + F.call_function("div", wide(wide(count + PRIOR) * wide(F.lit(SCALE))), wide(total + terms * PRIOR))).cast("long")


def reduced(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)]
    return keys[edge], np.add.reduceat(values, edge) if len(keys) else values


def tree_corrections(s: np.ndarray, p: np.ndarray, z: np.ndarray, offs: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum) for pairs of sources a < b that rows hold together.

    s, p, z: source, share and share without occurrences of the rows' items, one row after another; offs: where rows
    begin; m: how often a row occurs. Rows come sorted and distinct. A node of the tree is a row's item that the row
    before doesn't have on the same path; it stands for all rows up to the next one that leaves the path.
    """
    length = np.diff(offs)
    deep, n = int(length.max(initial=0)), len(length)
    name, code = np.unique(s, return_inverse=True)
    grid = np.full((3, n, deep), -1, np.int64)
    row, col = np.repeat(np.arange(n), length), np.arange(len(s)) - np.repeat(offs[:-1], length)
    for x, v in zip(grid, (code, p, z)):
        x[row, col] = v
    same = (grid[0, 1:] == grid[0, :-1]) & (grid[1, 1:] == grid[1, :-1]) & (grid[0, 1:] >= 0)
    shared = np.r_[0, np.logical_and.accumulate(same, axis=1).sum(1)] if n else np.zeros(0, int)
    total = np.r_[0, np.cumsum(m)]
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for d in range(1, deep):
        border = np.flatnonzero(shared <= d)
        times = np.diff(np.r_[total[border], total[-1]])
        node = length[border] > d
        border, times = border[node], times[node][:, None]
        b, pb, zb = (x[border, d : d + 1] for x in grid)
        a, pa_, za = (x[border, :d] for x in grid)  # the ancestors
        c = times * (np.abs(pa_ - pb) - np.abs(pa_ - zb) - np.abs(za - pb) + np.abs(za - zb))
        k, v = reduced((a * len(name) + b).ravel(), c.ravel())
        keys, sums = reduced(np.r_[keys, k], np.r_[sums, v])
    return name[keys // max(1, len(name))], name[keys % max(1, len(name))], sums


def pair_corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, c): sums of corrections of subtrees. rows: (lang, path array<struct<s, p, z>>, m), sorted in partitions."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column(0).dictionary_encode()
            path, m = batch.column(1), batch.column(2).to_numpy()
            offs = path.offsets.to_numpy().astype(np.int64)
            s, p, z = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in path.values.flatten())
            code = lang.indices.to_numpy()
            edge = np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), len(code)]
            for lo, hi in zip(edge[:-1], edge[1:]):
                while lo < hi:  # long rows a few at a time
                    to = min(hi, max(lo + 1, int(np.searchsorted(offs, offs[lo] + CELLS // 4, "right")) - 1))
                    own = slice(offs[lo], offs[to])
                    a, b, c = tree_corrections(s[own], p[own], z[own], offs[lo : to + 1] - offs[lo], m[lo:to])
                    yield pa.RecordBatch.from_arrays([pa.array([lang.dictionary[int(code[lo])].as_py()] * len(a), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(c)], names=["lang", "a", "b", "c"])
                    lo = to

    return rows.mapInArrow(run, "lang string, a int, b int, c long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources of the language by the sum of the
    shares' differences over all kept terms, part `term` the ``top`` terms that the source has more often than its language.

    A row is a document; rows that repeat another count again. Null text, lang and source are ''. A language keeps the
    terms that ``least_docs`` of its documents hold at least. A source without terms has every kept term with no occurrences; a
    language without kept terms gives its pairs the value 0 and no terms. Ties rank by the item's UTF-8 bytes. Whole texts
    count, of any length; other columns of docs are not looked at, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    each = Window.partitionBy("lang", "term")
    counts = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.select("lang", "term", "source", "n", F.sum("docs").over(each).alias("in_docs"), F.sum("n").over(each).alias("in_lang"), (F.row_number().over(each.orderBy("source")) == 1).alias("first"))
    counts = keep(counts.where(F.col("in_docs") >= least_docs).drop("in_docs"), "terms")
    langs = counts.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    stats = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "own", "terms", "lang_total"])
    stats = stats.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source"))).withColumn("z", share(F.lit(0), F.col("total"), F.col("terms")))
    stats = keep(stats, "stats")

    cells = ids_join(counts, stats, ["lang", "source"], "inner", most=100_000)
    cells = keep(cells.select("lang", "source", "term", "s", "z", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q")), "cells")
    out = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    rows = cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("s", "p", "z"))).alias("path")).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("m"))
    rows = keep(rows, "rows")
    n = max(1, min(partitions(spark), rows.count()), -(-(rows.agg(F.sum(F.size("path"))).first()[0] or 0) // CELLS))
    both = pair_corrections(rows.repartitionByRange(n, "lang", "path").sortWithinPartitions("lang", "path"))
    both = keep(both.groupBy("lang", "a", "b").agg(F.sum("c").alias("c")), "corrections")

    # for each source a and each z of another one b: the sum of abs(p - z) over the terms of a
    one = stats.select("lang", F.col("s").alias("a"), F.col("z").alias("za"), "own", "terms")
    other = stats.select("lang", F.col("s").alias("b"), F.col("z").alias("zb"))
    none = F.lit(None)
    ask = one.join(other, "lang").where("a <> b").select("lang", "a", "b", "za", "own", "terms", F.col("zb").alias("x"), F.lit(0).cast("long").alias("n"))
    have = cells.groupBy("lang", F.col("s").alias("a"), F.col("p").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    have = have.select("lang", "a", none.cast("int").alias("b"), none.cast("long").alias("za"), none.cast("long").alias("own"), none.cast("long").alias("terms"), "x", "n")
    source = Window.partitionBy("lang", "a")
    upto = source.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    line = ask.unionByName(have).select("*", *(f.alias(c) for c, f in {"below": F.sum("n").over(upto), "sum_below": F.sum(F.col("n") * F.col("x")).over(upto), "sum_all": F.sum(F.col("n") * F.col("x")).over(source)}.items()))
    apart = F.expr("x * below - sum_below + (sum_all - sum_below) - x * (own - below)")
    line = line.where("b is not null").select("lang", "a", "b", F.when(F.col("terms") > 0, apart - F.col("own") * F.abs(F.col("za") - F.col("x"))).otherwise(0).alias("c"), F.when(F.col("terms") > 0, F.col("terms") * F.abs(F.col("za") - F.col("x"))).otherwise(0).alias("base"))
    swapped = [F.col("lang"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("c")]
    parts = line.select("lang", "a", "b", (F.col("c") + F.col("base")).alias("c")).union(line.select(swapped)).union(both.select("lang", "a", "b", "c")).union(both.select(swapped))
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("c").cast("long").alias("value"))
    names = stats.select("lang", "s", "source")
    pairs = sums.join(names.select("lang", F.col("s").alias("a"), "source"), ["lang", "a"]).join(names.select("lang", F.col("s").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    discard(counts, rows)
    return pairs.unionByName(terms)
