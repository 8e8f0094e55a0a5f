"""Line deduplication over the whole corpus: repeated lines, and lines within a few edits of an earlier one.

Equal lines are a class, known by 128 bits of BLAKE2b. For near lines, every line of l characters is cut into
EDITS + 1 even segments. Of two lines within EDITS edits one holds a segment of the other almost at its
place, so that each line puts its own segments, and the substrings that could be a segment of a line of
its length or up to EDITS shorter, under hashes of (length, segment, characters). Lines that meet under
a key and differ little in the parities of their character pairs are fetched with their texts and meet
once more, in cells of bounded size: there a pair is verified under the least key that it shares, by a
banded bit-parallel edit distance, and only counts of near earlier lines leave the task. A line goes if it
is not the first of its class, or if an earlier line is near it; order is that of (doc_id, line number).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import discard, ids_join, keep, partitions, tidied

EDITS = 2
LEAST_EXACT, LEAST_NEAR = 10, 20  #: characters; what the parameters least_exact and least_near are unless given
SHORT_RUN = 24
CELL = 1024  #: lines of one key that meet in one task, at most
BUCKET_BYTES = 8 << 20  #: of keys in a bucket or of lines in a partition, about
FLUSH = 40_000
FLIPS = 4 * EDITS  #: parities of character pairs that so many edits can turn


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number of every line of a block of texts; an empty text has one empty line."""
    cut = np.flatnonzero(data == 10)
    starts = np.r_[offs[:-1], cut + 1]
    rows = np.r_[np.arange(len(offs) - 1), np.searchsorted(offs, cut, "right") - 1]
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.r_[starts[1:] - 1, offs[-1]]
    first = np.r_[True, rows[1:] != rows[:-1]]
    last = np.r_[first[1:], True]
    ends[last] = offs[rows[last] + 1]
    at = np.flatnonzero(first)
    number = np.arange(len(rows)) - np.repeat(at, np.diff(np.r_[at, len(rows)]))
    return starts, ends, rows, number


def blank(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    seen = np.r_[0, np.cumsum(~tb.SPACE[data])]
    return seen[ends] == seen[starts]


def characters(data: np.ndarray) -> np.ndarray:
    """Where characters begin, and the end."""
    return np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]


def line_table(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, version, line, h1, h2) of the lines that are not blank and have so many characters or more."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                data, offs = tb.raw(b.column(2))
                starts, ends, rows, number = line_spans(data, offs)
                size = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                use = (size[ends] - size[starts] >= least) & ~blank(data, starts, ends)
                starts, ends = starts[use], ends[use]
                doc, version = (b.column(i).to_numpy(zero_copy_only=False)[rows[use]] for i in (0, 1))
                h1, h2 = (np.ascontiguousarray(x) for x in tb.digests(data, starts, ends).view(np.int64).T)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(version, pa.int64()), pa.array(number[use].astype(np.int32)), pa.array(h1), pa.array(h2)], names=["doc_id", "version", "line", "h1", "h2"])

    return docs.select("doc_id", "version", "text").mapInArrow(run, "doc_id long, version long, line int, h1 long, h2 long")


def keys_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (lines, keys), which of the columns are the lines' own segments, and the parities of lines of LEAST_NEAR characters or more."""
    cs = characters(data)
    c0 = np.searchsorted(cs, starts)
    length = np.searchsorted(cs, ends) - c0
    spans = tb.Spans(data)
    keys, own = [], []
    for less in range(EDITS + 1):
        l = length - less
        short = l // (EDITS + 1)
        longer = l - short * (EDITS + 1)  # so many segments at the end have a character more
        at = np.zeros_like(l)
        for i in range(EDITS + 1):
            size = short + (i >= EDITS + 1 - longer)
            for shift in range(max(-i, less - (EDITS - i)), min(i, less + (EDITS - i)) + 1):
                lo = np.clip(at + shift, 0, None)
                ok = (at + shift >= 0) & (lo + size <= length)
                lo = np.where(ok, lo, 0)
                h = spans(cs[c0 + lo], cs[c0 + lo + size])
                with np.errstate(over="ignore"):
                    h = tb.mix(h + l.astype(tb.U) * tb.U(0xC2B2AE3D27D4EB4F) + tb.U(i + 1) * tb.U(0x165667B19E3779F9))
                keys.append(np.where(ok, h, tb.U(0)))
                own.append(less == 0 and shift == 0)
            at = at + size
    code = spans(cs[:-1], cs[1:])
    with np.errstate(over="ignore"):
        pair = tb.mix(code[:-1] * tb.U(3) + code[1:]) if len(code) > 1 else code[:0]
    bit = (np.uint32(2) << (pair % tb.U(31)).astype(np.uint32)).astype(np.uint32)
    edges = np.stack([c0, c0 + length - 1], 1).ravel()
    parity = np.bitwise_xor.reduceat(np.r_[bit, np.zeros(2, np.uint32)], edges)[::2] if len(c0) else np.zeros(0, np.uint32)
    return np.stack(keys, 1), np.array(own), parity


def long_runs_met(key: np.ndarray, of: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted, distinct (key, line, sig): which go to the key's bucket, and which have met here, in a long run of several lines and an own segment."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[edge, len(key)])
    long = (size > SHORT_RUN) & (sig[edge] & 1 == 1) & (np.minimum.reduceat(of, edge) != np.maximum.reduceat(of, edge))
    met, run = np.repeat(long, size), np.repeat(np.arange(len(edge)), size)
    stay = ~met | (np.arange(len(key)) - edge[run] <= SHORT_RUN)
    other = np.flatnonzero(met & (of != of[edge][run]))
    stay[other[np.r_[True, run[other][1:] != run[other][:-1]][: len(other)]]] = True  # one more of another line than the first
    return stay, met


def probes(docs: DataFrame, buckets: int, least: int) -> DataFrame:
    """Bundles for each bucket: keys, the line's hash, and parities whose lowest bit marks the line's own segments.

    Lines of a key that is frequent in a task have met there (met); they go to any bucket, and to the key's own bucket as
    few of them as make the run a long one, so that a bucket gets some 30 of a key from a task, however many lines have it.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        own = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, h1, parity = (np.concatenate(x) for x in zip(*held))
            held.clear()
            h1, first = np.unique(h1, return_index=True)
            keys, parity = keys[first], parity[first]
            sig = parity[:, None] | own.astype(np.uint32)[None]
            key, of = keys.ravel(), np.repeat(np.arange(len(h1)), keys.shape[1])
            sig = sig.ravel()
            order = np.lexsort((sig, of, sig & 1 ^ 1, key))  # a run begins with lines that have the key as their own segment
            key, of, sig = key[order], of[order], sig[order]
            use = (key != 0) & np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]) | (sig[1:] != sig[:-1])][: len(key)]
            key, of, sig = key[use], of[use], sig[use]
            stay, met = long_runs_met(key, of, sig)
            spread = (np.arange(len(key)) >> 12) + int(h1[0] % buckets)
            for done, use, bucket in ((False, stay, key % tb.U(buckets)), (True, met, spread % buckets)):
                if not use.any():
                    continue
                bucket = bucket[use].astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                k, o, s, bucket = key[use][order], of[use][order], sig[use][order], bucket[order]
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                rows = [(int(bucket[lo]), k[lo:hi].tobytes(), h1[o[lo:hi]].tobytes(), s[lo:hi].tobytes(), done) for lo, hi in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()))], names=["bucket", "key", "h1", "sig", "met"])

        for batch in batches:
            for b in tb.blocks(batch, "text"):
                data, offs = tb.raw(b.column(1))
                starts, ends, _, _ = line_spans(data, offs)
                size = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                use = (size[ends] - size[starts] >= least) & ~blank(data, starts, ends)
                if not use.any():
                    continue
                keys, own, parity = keys_of(data, starts[use], ends[use])
                held.append((keys, tb.digests(data, starts[use], ends[use])[:, 0].view(np.int64), parity))
                if sum(len(x[1]) for x in held) >= FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, key binary, h1 binary, sig binary, met boolean")


def meet(bundles: DataFrame) -> DataFrame:
    """(key, h1), maybe several times: lines that share a key with others, one of them by its own segment; in short runs only where parities allow a pair."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: tuple[list, list, list] = ([], [], [])
        for b in batches:
            for k, h, s, met in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (k, h)], names=["key", "h1"])
                    continue
                for col, x, kind in zip(cols, (k, h, s), (tb.U, np.int64, np.uint32)):
                    col.append(np.frombuffer(x, kind))
        if not cols[0]:
            return
        key, h1, sig = map(np.concatenate, cols)
        order = np.argsort(key, kind="stable")
        key, h1, sig = key[order], h1[order], sig[order]
        many = np.r_[False, key[1:] == key[:-1]]
        many[:-1] |= many[1:]
        key, h1, sig = key[many], h1[many], sig[many]
        order = np.lexsort((sig, h1, key))
        key, h1, sig = key[order], h1[order], sig[order]
        if not len(key):
            return
        new = np.r_[True, (key[1:] != key[:-1]) | (h1[1:] != h1[:-1]) | (sig[1:] != sig[:-1])]
        key, h1, sig = key[new], h1[new], sig[new]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[edge, len(key)])
        length = np.repeat(size, size)
        left = np.repeat(edge + size, size) - np.arange(len(key))
        owned = np.logical_or.reduceat((sig & 1).astype(bool), edge)
        met = np.repeat((size > SHORT_RUN) & owned & (np.minimum.reduceat(h1, edge) != np.maximum.reduceat(h1, edge)), size)
        for k in range(1, min(SHORT_RUN, int(size.max()))):
            i = np.flatnonzero((length <= SHORT_RUN) & (left > k))
            j = i + k
            ok = ((sig[i] | sig[j]) & 1).astype(bool) & (h1[i] != h1[j]) & (np.bitwise_count((sig[i] ^ sig[j]) >> 1) <= FLIPS)
            met[i[ok]] = met[j[ok]] = True
        key, h1 = key[met], h1[met]
        new = np.r_[True, (key[1:] != key[:-1]) | (h1[1:] != h1[:-1])][: len(key)]
        key, h1 = key[new].view(np.int64), h1[new]
        for x in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[x : x + 100_000]), pa.array(h1[x : x + 100_000])], names=["key", "h1"])

    return bundles.mapInArrow(run, "key long, h1 long")


def distances(left: list[str], right: list[str], edits: int = EDITS) -> np.ndarray:
    """Edit distances of pairs, exact up to ``edits`` (larger ones are some larger number).

    A band of 2 * edits + 1 diagonals is one machine word for each pair, and a step takes the next character
    of all pairs at once. Equal characters behind both texts bring all to one length, which changes no distance.
    """
    out = np.full(len(left), edits + 1)
    m, n = np.array([len(x) for x in left], int), np.array([len(x) for x in right], int)
    todo = np.flatnonzero(np.abs(m - n) <= edits)
    todo = todo[np.argsort(n[todo], kind="stable")]
    width, mask = 2 * edits + 1, np.uint64((1 << (2 * edits + 1)) - 1)
    lo = 0
    while lo < len(todo):
        own = todo[lo : lo + 2048]
        own = own[: max(1, int(np.searchsorted(np.cumsum(n[own]), 2_000_000)))]  # long lines a few at a time
        lo += len(own)
        steps = int(n[own].max())
        if not steps:
            out[own] = m[own]
            continue
        a = np.full((len(own), steps + 2 * width + edits), 0x110001, np.int32)  # rows from 1 - edits on
        b = np.full((len(own), steps), 0x110002, np.int32)
        for r, i in enumerate(own):
            x, y = (np.frombuffer(s[i].encode("utf-32-le", "surrogatepass"), np.int32) for s in (left, right))
            a[r, edits : edits + len(x)] = x
            a[r, edits + len(x) : edits + len(x) + steps - len(y)] = 0x110002
            b[r, : len(y)] = y
        rows = m[own] + steps - n[own]
        vp, vn = np.full(len(own), ((1 << edits + 1) - 1) << edits, np.uint64), np.zeros(len(own), np.uint64)
        score, top, one = np.full(len(own), edits), np.uint64(2 * edits), np.uint64(1)
        for j in range(steps):  # bit t is row j + 1 - edits + t
            eq = np.zeros(len(own), np.uint64)
            for t in range(width):
                eq |= (a[:, j + t] == b[:, j]).astype(np.uint64) << np.uint64(t)
            d0 = (((eq & vp) + vp) ^ vp | eq | vn) & mask
            hp = (vn | ~(d0 | vp)) & mask
            hn = d0 & vp
            score += 1 - (d0 >> top & one).astype(int)
            vp = (hn | ~(d0 >> one | hp)) & mask
            vn = d0 >> one & hp
        for t in range(2 * edits):  # back from the band's last row to the text's, by the last column's vertical steps
            bit = np.uint64(t)
            score -= np.where(steps + 1 - edits + t > rows, (vp >> bit & one).astype(int) - (vn >> bit & one).astype(int), 0)
        out[own] = np.minimum(score, edits + 1)
    return out


def least_shared(keys: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least key that lines i and j share, one of them by its own segment; 0 if there is none."""
    out = np.zeros(len(i), tb.U)
    for x in range(0, len(i), 20_000):
        a, b = keys[i[x : x + 20_000]], keys[j[x : x + 20_000]]
        most = np.full(len(a), ~tb.U(0))
        for p in range(keys.shape[1]):
            same = ((a[:, p, None] == b) & (own[p] | own)).any(1) & (a[:, p] != 0)
            most = np.where(same, np.minimum(most, a[:, p]), most)
        out[x : x + 20_000] = np.where(most == ~tb.U(0), tb.U(0), most)
    return out


def count_near(dealt: DataFrame) -> DataFrame:
    """(first, links): of each line that is near an earlier one in a cell, its place and with how many.

    dealt: (key, x, y, b, at, text); a line of block b is in the cells of its key that have b as x or y.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(p.num_rows for p in parts):
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        key, x, y, b, doc, version, line = (rows.column(c).to_numpy() for c in ("key", "x", "y", "b", "doc_id", "version", "line"))
        texts = rows.column("text").combine_chunks()
        keys, own, parity = np.zeros((len(key), 0), tb.U), None, np.zeros(len(key), np.uint32)
        got = []
        for lo in range(0, len(key), 20_000):
            data, offs = tb.raw(texts[lo : lo + 20_000])
            k, own, parity[lo : lo + 20_000] = keys_of(data, offs[:-1], offs[1:])
            got.append(k)
        keys = np.concatenate(got)
        _, place = np.unique(np.rec.fromarrays([doc, version, line]), return_inverse=True)  # in the order of (doc_id, version, line)
        size = np.array([len(t) for t in texts.to_pylist()])
        by = np.lexsort((b, y, x, key))
        new = (np.diff(key[by]) != 0) | (np.diff(x[by]) != 0) | (np.diff(y[by]) != 0)
        edge = np.r_[0, np.flatnonzero(new) + 1, len(by)]
        links = np.zeros(len(key), np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def check() -> None:
            if held:
                i, j = (np.concatenate(v) for v in zip(*held))
                held.clear()
                near = distances(texts.take(pa.array(i)).to_pylist(), texts.take(pa.array(j)).to_pylist()) <= EDITS
                np.add.at(links, np.where(place[i] > place[j], i, j)[near], 1)

        for lo, hi in zip(edge[:-1], edge[1:]):
            cell = by[lo:hi]
            for r in range(0, len(cell), 256):
                i, j = cell[r : r + 256, None], cell
                ok = (np.bitwise_count((parity[i] ^ parity[j]) >> 1) <= FLIPS) & (np.abs(size[i] - size[j]) <= EDITS) & (place[i] < place[j])
                if x[cell[0]] != y[cell[0]]:
                    ok &= b[i] != b[j]
                p, q = np.nonzero(ok)
                i, j = cell[r + p], cell[q]
                use = least_shared(keys, own, i, j) == key[i].view(tb.U)
                held.append((i[use], j[use]))
                if sum(len(v[0]) for v in held) > 100_000:
                    check()
        check()
        use = np.flatnonzero(links)
        first = pa.StructArray.from_arrays([pa.array(v[use]) for v in (doc, version, line)], names=["doc_id", "version", "line"])
        yield pa.RecordBatch.from_arrays([first, pa.array(links[use])], names=["first", "links"])

    return dealt.mapInArrow(run, "first struct<doc_id:long,version:long,line:int>, links long")


def near_lines(docs: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """(first, links): the first places of classes of lines that are near earlier ones, and near how many. firsts: (h1, h2, first, n)."""
    spark = docs.sparkSession
    buckets = max(partitions(spark), -(-240 * firsts.count() // BUCKET_BYTES))
    met = keep(meet(probes(docs, buckets, least).repartitionById(buckets, F.col("bucket"))).distinct(), "met")
    wanted = keep(met.select("h1").distinct().join(firsts.select("h1", "first"), "h1"), "wanted")
    per_doc = wanted.groupBy("first.doc_id", "first.version").agg(F.sort_array(F.collect_set(F.struct("first.line", "h1"))).alias("lines"))
    per_doc = keep(per_doc, "lines")

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, v, text, lines in zip(*(c.to_pylist() for c in b.columns)):
                parts = (text or "").split("\n")
                rows += [(x["h1"], d, v, x["line"], parts[x["line"]]) for x in lines if x["line"] < len(parts)]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["h1", "doc_id", "version", "line", "text"])

    texts = ids_join(docs.select("doc_id", "version", "text"), per_doc, ["doc_id", "version"], "inner", size=wanted.count())
    texts = texts.mapInArrow(cut, "h1 long, doc_id long, version long, line int, text string")
    texts = keep(texts.dropDuplicates(["h1", "doc_id", "version", "line"]), "texts")  # of rows that are repeated as a whole
    long_runs = keep(met.groupBy("key").count().where(F.col("count") > CELL).select("key", F.ceil(F.col("count") / CELL).cast("int").alias("blocks")), "runs")
    runs = met.join(long_runs, "key", "left").join(texts, "h1").withColumn("b", F.coalesce(F.pmod(F.xxhash64("h1"), "blocks"), F.lit(0)).cast("int"))
    runs = runs.withColumn("other", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)"))).withColumns({"x": F.least("b", "other"), "y": F.greatest("b", "other")})
    n_bytes = met.join(long_runs, "key", "left").join(texts.select("h1", F.length("text").alias("n")), "h1").agg(F.sum(F.expr("(n + 200) * coalesce(blocks, 1)"))).first()[0] or 0
    dealt = runs.select("key", "x", "y", "b", "doc_id", "version", "line", "text").repartition(max(partitions(spark), -(-n_bytes // BUCKET_BYTES)), "key", "x", "y")
    out = keep(count_near(dealt).groupBy("first").agg(F.sum("links").alias("links")), "near")
    discard(met, wanted, per_doc, texts, long_runs)
    return out


def versions(docs: DataFrame) -> DataFrame:
    """docs with a number for each text, which tells rows of one doc_id and different texts apart."""
    return docs.withColumn("version", F.xxhash64("text"))


def removals(docs: DataFrame, least_exact: int = LEAST_EXACT, least_near: int = LEAST_NEAR) -> DataFrame:
    """(doc_id, version, exact array<int>, near array<int>, n_links long): the numbers of the lines that go, for documents with any.

    n_links counts the pairs of different near lines whose later one has its first place in the document.
    """
    docs = versions(docs.select("doc_id", "text").where("doc_id is not null and text is not null"))
    lines = keep(line_table(docs, least_exact), "lines")
    place = F.struct("doc_id", "version", "line")
    firsts = keep(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    near = near_lines(docs, firsts, max(least_exact, least_near))
    verdict = keep(firsts.join(near, "first", "left").where("n > 1 or links is not null"), "verdict")
    gone = lines.join(verdict, ["h1", "h2"]).withColumn("is_first", place == F.col("first")).where("not is_first or links is not null")
    by_near = F.col("links").isNotNull()
    return gone.groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.when(~by_near, F.col("line")))).alias("exact"),
        F.array_sort(F.collect_set(F.when(by_near, F.col("line")))).alias("near"),
        F.coalesce(F.sum(F.when(F.col("is_first"), F.col("links"))), F.lit(0)).alias("n_links"),
    )


def report(docs: DataFrame, least_exact: int = LEAST_EXACT, least_near: int = LEAST_NEAR) -> DataFrame:
    """One row for each row of docs: how many lines it has, which go as repeated and which as near an earlier line.

    A null text has no line, an empty one a single empty line. Blank lines always stay, and so do lines with fewer
    than ``least_exact`` characters; lines with fewer than ``least_near`` go only as repeated. Texts and lines of any
    length count whole. Rows that repeat a doc_id with one text are one document's; with different texts they are
    different documents in the order of a hash of their texts. A row without a doc_id keeps its lines and counts for none.
    """
    none = F.array().cast("array<int>")
    gone = removals(docs, least_exact, least_near).withColumnRenamed("doc_id", "id")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    out = versions(docs.select("doc_id", "text")).select("doc_id", "version", n_lines.alias("n_lines"))
    return out.join(gone.withColumnRenamed("version", "of"), (F.col("doc_id") == F.col("id")) & (F.col("version") == F.col("of")), "left").select(
        "doc_id", "n_lines", F.coalesce("exact", none).alias("exact_removed"), F.coalesce("near", none).alias("near_removed"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def dedup(docs: DataFrame, drop_emptied: bool = False, least_exact: int = LEAST_EXACT, least_near: int = LEAST_NEAR) -> DataFrame:
    """docs with the lines that report names taken out of ``text`` (and n_chars, if there, counted anew); other columns stay.

    Texts that lose no line stay as they are, null ones too. No row goes, unless ``drop_emptied``: then a document
    goes if it loses lines and what is left is blank, as everything that it said stands in earlier documents.
    """
    gone = removals(docs, least_exact, least_near).select(F.col("doc_id").alias("__id"), F.col("version").alias("__of"), F.array_union("exact", "near").alias("__gone"))

    texts = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, lost = b.columns[:-1], b.column(b.num_columns - 1)
            at = np.flatnonzero(pc.fill_null(pc.greater(pc.list_value_length(lost), 0), False).to_numpy(zero_copy_only=False))
            if not len(at):
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])
                continue
            text, left = cols[texts].to_pylist(), np.ones(b.num_rows, bool)
            n_chars = cols[counted].to_pylist() if counted is not None else None
            for i, drop in zip(at, lost.take(pa.array(at)).to_pylist()):
                drop = set(drop)
                text[i] = "\n".join(x for k, x in enumerate(text[i].split("\n")) if k not in drop)
                left[i] = not drop_emptied or bool(text[i].strip(" \t\n\r\x0b\x0c"))
                if n_chars is not None:
                    n_chars[i] = len(text[i])
            cols[texts] = pa.array(text, cols[texts].type)
            if n_chars is not None:
                cols[counted] = pa.array(n_chars).cast(cols[counted].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1]).filter(pa.array(left))

    joined = docs.join(gone, (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__of")), "left")
    return joined.select(*(docs[f"`{c}`"] for c in docs.columns), "__gone").mapInArrow(run, docs.schema)
