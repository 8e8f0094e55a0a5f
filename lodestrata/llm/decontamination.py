"""Which words of documents stand in passages of a benchmark, by a prefix-filtered set join.

A window is WINDOW consecutive words of an item, or a shorter item as a whole; its set are its shingles of SHINGLE words. One pass
over all documents counts how often each shingle of the benchmark occurs, and orders a window's shingles by rarity. A window must
be contained as a whole, so that its rarest shingle is a sufficient prefix; a window with a shingle that occurs nowhere is
out at once. A second pass finds the prefixes in the documents and hands on each place with the words around it, as
many as a window can reach. The join on the prefix then applies the bounds of length and position and compares the windows word by word, so
that hashes only propose. Documents themselves are never shuffled. The benchmark's hashes reach the tasks in blocks of at most
LOOKUP; a larger benchmark means another pass for each further block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import discard, keep, tidied

WINDOW, SHINGLE = 10, 3
LOOKUP = 2_000_000  #: hashes sent to every task at once, 8 bytes each
INNER = tb.table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])  # once A-Z are lower-case
BITS = 1 << 22


class Lookup:
    """Ascending 64-bit hashes, with a bitmap before the search."""

    def __init__(self, hashes: np.ndarray, widths: list[int]):
        self.hashes, self.widths = hashes, widths
        self.bits = np.zeros(BITS, bool)
        self.bits[hashes & tb.U(BITS - 1)] = True

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Which of ``asked`` are among the hashes."""
        at = np.flatnonzero(self.bits[asked & tb.U(BITS - 1)])
        if not len(self.hashes):
            return at[:0]
        place = np.minimum(np.searchsorted(self.hashes, asked[at]), len(self.hashes) - 1)
        return at[self.hashes[place] == asked[at]]


def word_hashes(words: pa.StringArray) -> np.ndarray:
    data, offs = tb.raw(words)
    return tb.Spans(data)(offs[:-1], offs[1:])


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Of each run of ``width`` words; equal words give equal hashes whatever stands around."""
    n = max(0, len(h) - width + 1)
    s = np.full(n, width, tb.U)
    with np.errstate(over="ignore"):
        for i in range(width):
            s = (s ^ (s >> tb.U(29))) * tb.U(0xD6E8FEB86659FD93) + h[i : i + n]
        return tb.mix(s)


def shingles_of(words: list[str]) -> list[int]:
    h = word_hashes(pa.array(words, pa.string()))
    return shingle_hashes(h, min(SHINGLE, len(words))).view(np.int64).tolist()


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(words array<string>, items array<string>, shingles array<long>): each different window once."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                data, offs = tb.raw(b.column(1))
                words, at = tb.tokens(tb.LOWER[data], offs, INNER)
                words = words.to_pylist()
                found = [(i, words[lo : min(lo + size, end)]) for i, first, end in zip(b.column(0).to_pylist(), at[:-1], at[1:]) for lo in range(first, max(first, end - size) + 1) if end > first]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.string())), pa.array([shingles_of(x[1]) for x in found], pa.list_(pa.int64()))], names=["item", "words", "shingles"])

    found = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, words array<string>, shingles array<long>")
    return found.groupBy("words", "shingles").agg(F.collect_set("item").alias("items"))


def blocks(hashes: DataFrame, widths: list[int]) -> Iterator[Lookup]:
    """The hashes (column h, distinct) in parts of at most LOOKUP; none, if there are none."""
    n = -(-hashes.count() // LOOKUP)
    for i in range(n if n < 2 else 2 * n):  # twice as many parts, as they are not quite even
        part = hashes if n < 2 else hashes.where(F.pmod(F.xxhash64("h"), F.lit(2 * n)) == i)
        yield Lookup(np.sort(part.toPandas()["h"].to_numpy(np.int64).view(tb.U)), widths)


def places(lookup: Lookup, words: pa.StringArray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word's place in the block, hash) of the lookup's shingles in a block's rows."""
    h = word_hashes(words)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, tb.U))]
    for k in lookup.widths:
        s = shingle_hashes(h, k)
        i = lookup.find(s)
        i = i[row[i] == row[i + k - 1]]
        out.append((row[i], i, s[i]))
    return tuple(np.concatenate(x) for x in zip(*out))


def count_shingles(docs: DataFrame, lookup: Lookup) -> DataFrame:
    """(h, n): occurrences of the lookup's shingles, summed for each task."""
    shared = docs.sparkSession.sparkContext.broadcast(lookup)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.value.hashes
        n = np.zeros(len(hashes), np.int64)
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                data, offs = tb.raw(b.column(0))
                words, at = tb.tokens(tb.LOWER[data], offs, INNER)
                found, times = np.unique(places(shared.value, words, at)[2], return_counts=True)
                n[np.searchsorted(hashes, found)] += times
        use = np.flatnonzero(n)
        for x in range(0, len(use), 100_000):
            i = use[x : x + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[i].view(np.int64)), pa.array(n[i])], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long")


def probe(docs: DataFrame, lookup: Lookup, size: int) -> DataFrame:
    """(doc_id, version, n_words, met array<struct<h, pos, first, words>>): of each row the prefixes' places, with the words around.

    words are those from ``first`` on that a window through this place can reach.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lookup)
    item = pa.struct([("h", pa.int64()), ("pos", pa.int64()), ("first", pa.int64()), ("words", pa.list_(pa.string()))])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                data, offs = tb.raw(b.column(2))
                words, at = tb.tokens(tb.LOWER[data], offs, INNER)
                row, i, h = places(shared.value, words, at)
                order = np.argsort(row, kind="stable")
                row, i, h = row[order], i[order], h[order]
                lo, hi = np.maximum(at[row], i - size + 1), np.minimum(at[row + 1], i + size)
                inside = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)][:-1], hi - lo) + np.arange(int((hi - lo).sum()))
                near = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(hi - lo)].astype(np.int32)), words.take(pa.array(inside)))
                met = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(i - at[row]), pa.array(lo - at[row]), near], fields=list(item))
                met = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)), met)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), met], names=["doc_id", "version", "n_words", "met"])

    return docs.select("doc_id", "version", "text").mapInArrow(run, "doc_id long, version long, n_words long, met array<struct<h:long,pos:long,first:long,words:array<string>>>")


def covered(spans: Column) -> Column:
    """How many words lie in any of the spans (from, to)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda x, s: F.struct((x["n"] + F.greatest(s["to"] - F.greatest(s["from"], x["to"]), F.lit(0))).alias("n"), F.greatest(x["to"], s["to"]).alias("to"))
    return F.aggregate(F.array_sort(spans), start, step, lambda x: x["n"])


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256,
    contaminated, and items, the sorted ids (as strings) of the items of which a window occurs.

    A null or empty text has no words; texts of any length count whole. Rows that repeat a doc_id are documents of their own, whatever their
    texts, rows without one too. An item without words has no window; windows that items share count for each of them. Of items that
    repeat an id, each text has its windows, and the id counts once; items without an id hit words and are not among the items. Empty tables
    give no rows, or no hits. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    known = keep(windows(benchmark, size), "windows")
    widths = sorted(x.k for x in known.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).distinct().collect())
    counts = spark.createDataFrame([], "h long, n long")
    for lookup in blocks(known.select(F.explode("shingles").alias("h")).distinct(), widths):
        counts = counts.union(count_shingles(docs, lookup))
    counts = keep(counts.groupBy("h").agg(F.sum("n").alias("n")), "counts")

    # the rarest shingle of each window; windows with one that occurs nowhere have fewer rows than shingles
    each = known.select("words", "shingles", F.posexplode("shingles").alias("offset", "h")).join(counts, "h", "left")
    prefix = each.groupBy("words").agg(F.min(F.struct("n", "h", "offset")).alias("rarest"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    prefix = keep(prefix.where("all").select("words", "rarest.h", F.col("rarest.offset").cast("long").alias("offset")), "prefixes")

    probes, met = [], None
    for lookup in blocks(prefix.select("h").distinct(), widths):
        probes.append(keep(probe(docs, lookup, size), "met"))
        some = probes[-1].where(F.size("met") > 0).select("doc_id", "version", "n_words", F.explode("met").alias("m")).select("doc_id", "version", "n_words", "m.*")
        met = some if met is None else met.union(some)
    if met is None:  # no window can occur
        probes.append(keep(probe(docs, Lookup(np.zeros(0, tb.U), []), size), "met"))
        met = probes[0].where("false").select("doc_id", "version", "n_words", F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("first"), F.array().cast("array<string>").alias("words"))
    met = met.withColumnRenamed("words", "near").join(prefix, "h").withColumn("from", F.col("pos") - F.col("offset")).withColumn("to", F.col("from") + F.size("words"))
    met = met.where("from >= 0 and to <= n_words")
    met = met.where(F.slice("near", (F.col("from") - F.col("first") + 1).cast("int"), F.size("words")) == F.col("words"))
    hits = keep(met.select("doc_id", "version", "from", "to", "words").distinct(), "hits")
    spans = hits.groupBy("doc_id", "version").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    items = hits.select("doc_id", "version", "words").distinct().join(known.select("words", F.explode("items").alias("item")), "words")
    items = items.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.select("doc_id", "version", covered(F.col("spans")).alias("n_hit")).alias("s")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.version") == F.col(f"{b}.version"))
    out = probes[0].select("doc_id", "version", "n_words").alias("d").join(found, same("d", "s"), "left").join(items.alias("i"), same("d", "i"), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "d.doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), ids.alias("items"),
    )
