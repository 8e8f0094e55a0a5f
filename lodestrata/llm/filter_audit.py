"""What each of five filters removes in any order: alone, after others, and for nothing.

One pass over whole texts gives every document its failing filters and its text's digest, by which a text that equals
one of a smaller doc_id is found. Documents are range-partitioned by (part, doc_id), so that a part of any size is many
id ranges. In a range each filter has a sorted posting list of failing ids. Unions of the lists grow one list at
a time by galloping merges, and what a filter removes after others is the difference of its list and their union. Only sizes
leave a range, 80 for each part (16 sets of earlier filters times the filter after them), and are summed; the 120 orders
are read off those sums.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .common import discard, keep, partitions, tidied

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
CAPITAL, MARK = tb.table([(65, 90)]), np.isin(np.arange(256), list(b"#$%&*|"))
STEPS = [(seen, f) for f in range(5) for seen in range(32) if not seen >> f & 1]
RANGE_ROWS = 500_000  #: documents of a task, about
BLOCK = 64


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, digest): of each document its failing filters A to D as bits, and a SHA-256 of its text."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                data, offs = tb.raw(b.column(2))
                words, at = tb.tokens(data, offs, tb.NOT_SPACE)
                n_words = np.diff(at)
                code, names = tb.coded(words)
                distinct = np.bincount(np.unique(np.repeat(np.arange(len(n_words)), n_words) * max(1, len(names)) + code) // max(1, len(names)), minlength=len(n_words))
                in_row = lambda use: np.diff(np.r_[0, np.cumsum(use)][offs])
                fails = (n_words < MIN_WORDS) | (100 * distinct < DISTINCT_PERCENT * n_words) << 1
                fails |= (100 * in_row(CAPITAL[data]) > CAPITAL_PERCENT * in_row((data & 0xC0) != 0x80)) << 2 | (in_row(MARK[data]) > 0) << 3
                view = memoryview(data)
                digest = [hashlib.sha256(view[lo:hi]).digest() for lo, hi in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fails.astype(np.int32)), pa.array(digest, pa.binary())], names=["doc_id", "part", "fails", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), "text").mapInArrow(run, "doc_id long, part string, fails int, digest binary")


def gallop(ids: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each of the ascending ``asked`` the first place in ``ids`` that is not below it.

    Every BLOCK-th is sought first; the others start from there, by doubling steps and then by halves, so that the
    work goes with the shorter list and the logarithm of the gaps.
    """
    if len(asked) > BLOCK:
        lo = np.repeat(gallop(ids, asked[::BLOCK]), BLOCK)[: len(asked)]
    else:
        lo = np.zeros(len(asked), np.int64)
    hi, step, n = lo.copy(), 1, len(ids)
    todo = np.flatnonzero(lo < n)
    while len(todo := todo[ids[hi[todo]] < asked[todo]]):
        lo[todo] = hi[todo] + 1
        hi[todo] = np.minimum(lo[todo] + step, n)
        step *= 2
        todo = todo[hi[todo] < n]
    while len(todo := np.flatnonzero(lo < hi)):
        mid = (lo[todo] + hi[todo]) // 2
        below = ids[mid] < asked[todo]
        lo[todo], hi[todo] = np.where(below, mid + 1, lo[todo]), np.where(below, hi[todo], mid)
    return lo


def held(ids: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` are among ``ids``."""
    at = gallop(ids, asked)
    out = at < len(ids)
    out[out] = ids[at[out]] == asked[out]
    return out


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ids of both lists, the shorter one merged into the longer."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    new = short[~held(long, short)]
    return np.insert(long, gallop(long, new), new)


def size_of_common(a: np.ndarray, b: np.ndarray) -> int:
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    return int(held(long, short).sum())


def range_sizes(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """(80, 5): of each step the sizes fails, removed, gone (by all filters so far), good and toxic ones removed."""
    unions = [lists[0][:0]]
    for seen in range(1, 32):
        last = seen.bit_length() - 1
        unions.append(union(unions[seen ^ 1 << last], lists[last]))
    out = []
    for seen, f in STEPS:
        removed = lists[f][~held(unions[seen], lists[f])]
        out.append((len(lists[f]), len(removed), len(unions[seen | 1 << f]), size_of_common(removed, good), size_of_common(removed, toxic)))
    return np.array(out, np.int64)


SIZES = ["n", "fails", "removed", "gone", "good_lost", "toxic_lost"]


def range_audits(tagged: DataFrame) -> DataFrame:
    """(part, seen, f, *SIZES) of the parts in each task. tagged: (part, doc_id, fails, good, toxic), sorted in partitions."""
    schema = "part string, seen int, f int, " + ", ".join(f"{x} long" for x in SIZES)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = None, np.zeros((80, 6), np.int64)

        def told() -> pa.RecordBatch:
            seen, f = np.array(STEPS, np.int32).T
            return pa.RecordBatch.from_arrays([pa.array([part] * 80, pa.string()), pa.array(seen), pa.array(f), *map(pa.array, sums.T)], names=["part", "seen", "f", *SIZES])

        for b in batches:
            runs = b.column(0).dictionary_encode()
            code = runs.indices.to_numpy()
            edge = np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), len(code)] if len(code) else [0]
            fails, good, toxic = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            for lo, hi in zip(edge[:-1], edge[1:]):
                name = runs.dictionary[int(code[lo])].as_py()
                if name != part:
                    if part is not None:
                        yield told()
                    part, sums = name, np.zeros((80, 6), np.int64)
                ids = np.arange(lo, hi)  # in the order of doc_id; rows that repeat one have ids of their own
                lists = [ids[fails[lo:hi] >> f & 1 == 1] for f in range(5)]
                sums[:, 0] += hi - lo
                sums[:, 1:] += range_sizes(lists, ids[good[lo:hi]], ids[toxic[lo:hi]])
        if part is not None:
            yield told()

    return tagged.select("part", "doc_id", "fails", "good", "toxic").mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows for each part (value of ``source``, null: ''): 120 orders of the filters A to E, five steps each.

    filter_order, step, and counts within the part: kept after the step, removed in it, redundant (failing its filter
    but removed before), unique_fails (failing its filter only), good_lost and toxic_lost (removed here and labelled so), shapley
    (removed by its filter, summed over all orders). Every row of docs is a document, repeated ones too. A null text
    is empty: too few words, and equal to other empty ones. E compares doc_ids over the whole table; rows without one
    never fail it, are nobody's original and have no label. Of several labels of a doc_id each that says 1 counts. Texts count whole. An
    empty table gives no rows; other columns aren't looked at.
    """
    spark = docs.sparkSession
    rows = keep(facts(docs), "facts")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    copied = F.when(F.col("first") < F.col("doc_id"), 1 << 4).otherwise(0)
    tagged = rows.join(first, "digest", "left").select("part", "doc_id", F.col("fails").bitwiseOR(copied).alias("fails")).join(marks, "doc_id", "left")
    tagged = keep(tagged.select("part", "doc_id", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))), "tagged")
    n = max(1, -(-tagged.count() // RANGE_ROWS))
    sums = range_audits(tagged.repartitionByRange(n, "part", "doc_id").sortWithinPartitions("part", "doc_id")).groupBy("part", "seen", "f").agg(*(F.sum(x).alias(x) for x in SIZES))
    sums = keep(sums, "sums")
    discard(rows, tagged)

    one = Window.partitionBy("part", "f")
    seen = F.bit_count("seen")
    orders_with = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(4 - k)) for k in range(5))), seen.cast("int") + 1)  # so many orders have these before and those after
    sums = sums.withColumns({"shapley": F.sum(F.col("removed") * orders_with).over(one), "unique_fails": F.sum(F.when(seen == 4, F.col("removed"))).over(one)})
    steps = []
    for order in itertools.permutations(range(5)):
        steps += [("".join(FILTERS[f] for f in order), k + 1, sum(1 << g for g in order[:k]), f) for k, f in enumerate(order)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, seen int, f int")  # 600 rows
    return sums.join(F.broadcast(steps), ["seen", "f"]).select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
