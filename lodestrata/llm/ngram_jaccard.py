"""Exact Jaccard join of documents by word shingles with a token-group matrix.

Equal shingle sets are one class, represented by its smallest doc_id. Under each of a few min-hashes every class
is compared with one leader, and what links is one component, so that thousands of near copies cost thousands of
comparisons. What is left are links between different components.

Classes are partitioned into groups of similar ones: by the least hash of their frequent tokens where these are
half of the set or more, as in large families of near copies, else by their components. Tokens are ordered with
the most frequent ones last. The matrix has, for every token that may witness a link (a set's first fifth in this
order: sets that overlap by four fifths share one of these), the classes and groups that hold it. Of two groups
that meet there, the classes of the smaller one ask for the larger one. Of every group the whole token union is
kept as a bitmap, which bounds how many tokens of the asking class it can hold: only groups that may reach four
fifths of the class are opened. In an opened group, dealt out in cells of bounded size, classes meet by bitmaps
first; those that still may link meet again with their whole sets, and only links between components leave the
task. No link between different components is missed.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .common import discard, ids_join, keep, partitions, tidied
from .graphs import components

WORDS, PERCENT = 5, 80
KEY = tuple(secrets.randbits(64) for _ in range(3))  #: of the words' hashes; tasks get the driver's
HOT_TOKENS = 1 << 19  #: tokens that go last in the order, at most; any number gives the same links
HOT_IN_TASK = 2  #: rows of one task that make a token a candidate for it
MAP = 16  #: 64-bit words of a bitmap
TURNS = 4  #: min-hashes under which classes meet a leader
CELL = 1024  #: askers and members of a group that meet in one task, at most
SHORT_RUN = 24
BUCKET_BYTES = 8 << 20  #: of witnesses in a bucket or of sets in a partition, about
BITS = [f"w{i}" for i in range(MAP)]
LEAST = [f"m{i}" for i in range(TURNS)]
TURN = np.random.default_rng(3).integers(1, 1 << 63, TURNS).astype(tb.U) | tb.U(1)
SUMS = "hot boolean, doc_id long, n long, s1 long, s2 long, " + ", ".join(f"{w} long" for w in LEAST + BITS) + ", parity binary"


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(tb.U).view(np.int64))


def parity(s: np.ndarray) -> bytes:
    """Parities of hash bits, twice as many as tokens or more: their halves can be laid over each other."""
    size = max(1024, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 1024
    return np.packbits((np.bincount((s & tb.U(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def flips(x: bytes, y: bytes) -> int:
    """How many parities differ, at the smaller size: two sets differ in as many tokens at least."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def summarise(docs: DataFrame) -> DataFrame:
    """Of each document set size, two fingerprints, min-hashes, bitmap and parities; of each task its frequent tokens (hot: token in s1, rows in n)."""

    names = ["hot", "doc_id", "n", "s1", "s2", *LEAST, *BITS, "parity"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.zeros(0, tb.U), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def fold() -> None:
            nonlocal tokens, counts
            new, n = np.unique(np.concatenate(held), return_counts=True) if held else (tokens[:0], counts[:0])
            held.clear()
            all_, where = np.unique(np.r_[tokens, new], return_inverse=True)
            sums = np.zeros(len(all_), np.int64)
            np.add.at(sums, where, np.r_[counts, n])
            most = np.partition(sums, -HOT_TOKENS)[-HOT_TOKENS] if len(sums) > HOT_TOKENS else 2
            use = sums >= max(2, most)
            tokens, counts = all_[use], sums[use]

        for batch in batches:
            for b in tb.blocks(batch, "text"):
                sets = tb.shingles(b.column(1), WORDS, KEY)
                n = np.array([len(s) for s in sets])
                flat = np.concatenate(sets)
                at = np.repeat(np.arange(len(n)), n)
                ends = np.r_[0, np.cumsum(n)]
                with np.errstate(over="ignore"):
                    one = np.r_[tb.U(0), np.cumsum(tb.mix(flat))]
                    two = np.r_[tb.U(0), np.cumsum(tb.mix(flat ^ tb.U(0x5851F42D4C957F2D)))]
                    s1, s2 = one[ends[1:]] - one[ends[:-1]], two[ends[1:]] - two[ends[:-1]]
                    least = np.zeros((TURNS, len(n)), tb.U)
                    for i in range(TURNS if len(flat) else 0):
                        least[i, n > 0] = np.minimum.reduceat(flat * TURN[i], ends[:-1][n > 0])
                bits = np.bincount(at * (MAP * 64) + (flat >> tb.U(54)).astype(np.int64), minlength=len(n) * MAP * 64).reshape(-1, MAP * 64) > 0
                words = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(n), bool)), b.column(0), pa.array(n, pa.int64()), signed(s1), signed(s2), *map(signed, least), *(pa.array(words[:, i]) for i in range(MAP)), pa.array([parity(x) for x in sets], pa.binary())],
                    names=names,
                )
                held.append(flat)
                if sum(map(len, held)) > 1_000_000:
                    fold()
        fold()
        use = counts >= HOT_IN_TASK
        zero = pa.array(np.zeros(use.sum(), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(use.sum(), bool)), zero, pa.array(counts[use]), signed(tokens[use]), *[zero] * (1 + TURNS + MAP), pa.nulls(use.sum(), pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SUMS)


def frequent(found: DataFrame) -> np.ndarray:
    """The HOT_TOKENS tokens that most rows hold, or a few less, the least frequent first."""
    counts = keep(found.groupBy("s1").agg(F.sum("n").alias("rows")), "counts")
    least, room = None, HOT_TOKENS
    for rows, n in sorted(map(tuple, counts.groupBy("rows").count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        least = rows
    out = counts.where(F.col("rows") >= least).toArrow() if least is not None else None
    discard(counts)
    if out is None:
        return np.zeros(0, tb.U)
    rows, tokens = out.column("rows").to_numpy(), out.column("s1").to_numpy().view(tb.U)
    return tokens[np.lexsort((tokens, rows))]


def witnesses(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Bundles of first fifths: for each bucket of tokens the classes (doc_id, size, component, group) and (token, class) pairs.

    docs: doc_id, text, c. ``hot``: the frequent tokens, the least frequent first.
    """
    order = np.argsort(hot, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((hot[order], order))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = sent.value
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            first = [v[4] for v in held]
            doc, n, c, grp = (np.array([v[i] for v in held], t) for i, t in enumerate((np.int64, np.int32, np.int64, np.int64)))
            size = np.array([len(f) for f in first])
            of = np.repeat(np.arange(len(first)), size)
            rest = n[of] - (np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size))  # tokens from here on
            tok = np.concatenate(first)
            held.clear()
            bucket = ((tok & tb.U(0xFFFFFFFF)) % tb.U(buckets)).astype(np.int64)
            by = np.lexsort((of, bucket))
            tok, of, bucket, rest = tok[by], of[by], bucket[by], rest[by]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            rows = []
            for lo, hi in zip(edge[:-1], edge[1:]):
                own, local = np.unique(of[lo:hi], return_inverse=True)
                rows.append((int(bucket[lo]), *(x.tobytes() for x in (doc[own], n[own], c[own], grp[own], tok[lo:hi], local.astype(np.int32), rest[lo:hi].astype(np.int32)))))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i else pa.int32()) for i, x in enumerate(zip(*rows))], names=["bucket", "doc", "n", "c", "grp", "tok", "of", "rest"])

        for batch in batches:
            for b in tb.blocks(batch, "text"):
                for d, c, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), tb.shingles(b.column(1), WORDS, KEY)):
                    m, grp = len(s), c
                    if not m:
                        continue
                    if len(known):
                        i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        is_hot = known[i] == s
                        frequent_ = s[is_hot]
                        if 2 * len(frequent_) >= m:
                            grp = int(frequent_[0].view(np.int64))
                        s = np.r_[s[~is_hot], frequent_[np.argsort(place[i[is_hot]], kind="stable")]]
                    held.append((d, m, c, grp, s[: m - -(-PERCENT * m // 100) + 1]))
                if len(held) >= 4096:
                    yield from flush()
        yield from flush()

    return docs.select("doc_id", "text", "c").mapInArrow(run, "bucket int, doc binary, n binary, c binary, grp binary, tok binary, of binary, rest binary")


def qualify(bundles: DataFrame) -> DataFrame:
    """(doc_id, grp, member): by the witnesses of a bucket, groups that a class must ask for, and the members it may meet there.

    Only classes of different components meet. Of two groups under a token the classes of the smaller one (by its
    classes in the bucket) ask for the larger one, and classes of one group for their own. With a witness as their
    first common token, two sets share what follows it in the shorter rest at most; in long runs the largest
    rest, the smallest and the greatest size of a group's classes there bound all of them.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        base = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns[1:])):
                got = [np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int32, np.int64, np.int64, tb.U, np.int32, np.int32))]
                got[5] = got[5] + base
                base += len(got[0])
                for c, g in zip(cols, got):
                    c.append(g)
        if not base:
            return
        doc, n, comp, grp, tok, of, rest = map(np.concatenate, cols)
        n, of, rest = n.astype(np.int64), of.astype(np.int64), rest.astype(np.int64)  # class and group are one number below
        by = np.argsort(tok, kind="stable")
        by = by[np.repeat(*(lambda c: (c > 1, c))(np.unique(tok, return_counts=True)[1]))]
        tok, of, rest = tok[by], of[by], rest[by]
        if not len(tok):
            return
        by = np.lexsort((doc[of], n[of], tok))
        tok, of, rest = tok[by], of[by], rest[by]
        edge = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        size = np.diff(np.r_[edge, len(tok)])
        length = np.repeat(size, size)
        left = np.repeat(edge + size, size) - np.arange(len(tok))  # places to the end of the run
        kinds, gid, classes_of = np.unique(grp, return_inverse=True, return_counts=True)
        by = np.argsort(classes_of, kind="stable")  # number groups so that the smaller number asks
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        kinds, gid = kinds[by], place[gid]
        codes = [np.zeros(0, np.int64)]  # class and group as one number
        met = np.zeros(len(doc), bool)
        for k in range(1, min(SHORT_RUN, int(size.max()))):
            i = np.flatnonzero((length <= SHORT_RUN) & (left > k))
            m, q = of[i], of[i + k]
            fit = (comp[m] != comp[q]) & (100 * n[m] >= PERCENT * n[q]) & ((100 + PERCENT) * np.minimum(rest[i], rest[i + k]) >= PERCENT * (n[m] + n[q]))
            m, q = m[fit], q[fit]
            asks = np.where(gid[m] < gid[q], m, q)
            to = m + q - asks
            met[to] = True
            codes.append(np.unique(asks * len(kinds) + gid[to]))
        for lo, m in zip(edge[size > SHORT_RUN], size[size > SHORT_RUN]):
            own, far = of[lo : lo + m], rest[lo : lo + m]
            by = np.argsort(gid[own], kind="stable")
            g, at = np.unique(gid[own][by], return_index=True)
            least, most, longest = np.minimum.reduceat(n[own][by], at), np.maximum.reduceat(n[own][by], at), np.maximum.reduceat(far[by], at)
            low, high = np.minimum.reduceat(comp[own][by], at), np.maximum.reduceat(comp[own][by], at)
            asked = np.zeros(len(g), bool)
            for x in range(0, m, 256):
                q = np.arange(x, min(m, x + 256))[:, None]
                nq, cq = n[own[q]], comp[own[q]]
                ok = (gid[own[q]] <= g) & ((low != cq) | (high != cq)) & (100 * most >= PERCENT * nq) & (100 * nq >= PERCENT * least) & ((100 + PERCENT) * np.minimum(far[q], longest) >= PERCENT * (nq + least))
                i, j = np.nonzero(ok)
                asked[j] = True
                codes.append(np.unique(own[x + i] * len(kinds) + g[j]))
            met[own[asked[np.searchsorted(g, gid[own])]]] = True
            if len(codes) > 64:
                codes = [np.unique(np.concatenate(codes))]
        code, met = np.unique(np.concatenate(codes)), np.flatnonzero(met)
        d = np.r_[doc[code // len(kinds)], doc[met]]
        g = np.r_[kinds[code % len(kinds)], grp[met]]
        member = np.r_[np.zeros(len(code), bool), np.ones(len(met), bool)]
        for x in range(0, len(d), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(v[x : x + 100_000]) for v in (d, g, member)], names=["doc_id", "grp", "member"])

    return bundles.mapInArrow(run, "doc_id long, grp long, member boolean")


def total(terms: list[Column]) -> Column:
    return reduce(lambda p, q: p + q, terms)


def near_enough(x: str, y: str) -> Column:
    """What sizes and bitmaps allow: the sizes are within the ratio, and sets that overlap so far differ in a ninth of both at most."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = total([F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in BITS])
    return (100 * F.least(nx, ny) >= PERCENT * F.greatest(nx, ny)) & ((100 + PERCENT) * differ <= (100 - PERCENT) * (nx + ny))


def union_allows(q: str, g: str) -> Column:
    """What a group's token union allows: it lacks a fifth of the class's tokens at most, and has classes of a fitting size."""
    n = F.col(f"{q}.n")
    lacks = total([F.bit_count(F.col(f"{q}.{w}").bitwiseAND(F.bitwise_not(f"{g}.{w}"))) for w in BITS])
    return (100 * lacks <= (100 - PERCENT) * n) & (100 * n >= PERCENT * F.col(f"{g}.least_n")) & (100 * F.col(f"{g}.n") >= PERCENT * n)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    n = np.array([len(x) for x in sets])
    at = np.repeat(np.arange(len(n)), n) * (MAP * 64)
    bits = np.bincount(at + (np.concatenate(sets) >> tb.U(54)).astype(np.int64), minlength=len(n) * MAP * 64).reshape(-1, MAP * 64) > 0
    return np.packbits(bits, axis=1).view(tb.U)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if len(x) > len(y):
        x, y = y, x
    i = np.searchsorted(y, x)
    common = int((y[np.minimum(i, len(y) - 1)] == x).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def candidates(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps and long parities allow a link."""
    pairs = keep(pairs, "pairs")
    ids = keep(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    known = keep(ids_join(sets.select("doc_id", "n", *BITS, "parity"), ids, "doc_id"), "known")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [(100 + PERCENT) * flips(x, y) <= (100 - PERCENT) * n for n, x, y in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    both = pairs.join(known.alias("x"), F.col("a") == F.col("x.doc_id")).join(known.alias("y"), (F.col("b") == F.col("y.doc_id")) & near_enough("x", "y"))
    out = keep(both.select("a", "b", F.expr("x.n + y.n"), "x.parity", F.col("y.parity").alias("other")).mapInArrow(run, "a long, b long"), "left")
    discard(pairs, ids, known)
    return out


def tokens_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, tokens) of the documents with these ids, from their texts."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in tb.shingles(b.column(1), WORDS, KEY)], pa.binary())], names=["doc_id", "tokens"])

    return keep(ids_join(docs.select("doc_id", "text"), keep(ids.distinct(), "ids"), "doc_id").mapInArrow(run, "doc_id long, tokens binary"), "tokens")


def links_of(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(np.frombuffer(x, tb.U), np.frombuffer(y, tb.U)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    both = pairs.join(tokens.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    return keep(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def of_both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))


def star_pairs(sets: DataFrame) -> DataFrame:
    """Under each min-hash that several classes share, every class and one leader of them."""
    own = sets.select("doc_id", F.posexplode(F.array(*LEAST)).alias("turn", "m"))
    leaders = own.groupBy("turn", "m").agg(F.min_by("doc_id", F.xxhash64("doc_id", "turn")).alias("leader"), F.count(F.lit(1)).alias("size"))
    leaders = keep(leaders.where("size > 1").drop("size"), "leaders")
    return own.join(leaders, ["turn", "m"]).where("doc_id <> leader").select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (v, c) after more links (a, b)."""

    def up(e: DataFrame, x: str) -> DataFrame:
        return e.join(comp.select(F.col("v").alias(x), F.col("c").alias("to")), x, "left").withColumn(x, F.coalesce("to", x)).drop("to")

    over = components(up(up(links, "a"), "b").where("a <> b"))
    own = links.select(F.col("a").alias("v")).union(links.select("b")).distinct()
    base = comp.join(own, "v", "full").select("v", F.coalesce("c", "v").alias("c"))
    return keep(base.join(over.select(F.col("v").alias("c"), F.col("c").alias("top")), "c", "left").select("v", F.coalesce("top", "c").alias("c")), "components")


def single(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with one row of each doc_id, the one with the least text (rows without a doc_id all stay), and whether any was repeated."""
    repeated = keep(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.take(1):
        return docs, False
    one = ids_join(docs, repeated, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return keep(ids_join(docs, repeated, "doc_id", "left_anti").unionByName(one), "single"), True


def cells(columns: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Askers and members, as row numbers, of every cell of a partition."""
    by = np.lexsort([columns[k] for k in ("member", "across", "down", "grp")])
    key = np.stack([columns[k][by] for k in ("grp", "down", "across")], 1)
    edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
    for lo, hi in zip(edge[:-1], edge[1:]):
        member = columns["member"][by[lo:hi]]
        yield by[lo:hi][~member], by[lo:hi][member]


def may_link(n: np.ndarray, comp: np.ndarray, bits: np.ndarray, askers: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of askers and members of different components whose sizes and bitmaps allow a link, some askers at a time."""
    for x in range(0, len(askers), 128):
        q = askers[x : x + 128, None]
        fit = (comp[q] != comp[members]) & (100 * np.minimum(n[q], n[members]) >= PERCENT * np.maximum(n[q], n[members]))
        i, j = np.nonzero(fit)
        i, j = askers[x + i], members[j]
        differ = np.zeros(len(i), np.int64)
        for w in range(MAP):
            differ += np.bitwise_count(bits[i, w] ^ bits[j, w])  # of unsigned words
        ok = (100 + PERCENT) * differ <= (100 - PERCENT) * (n[i] + n[j])
        yield i[ok], j[ok]


def column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def still_alive(dealt: DataFrame) -> DataFrame:
    """Of classes dealt out in cells those that may link with another there, by their bitmaps."""
    kept = ["grp", "down", "across", "member", "doc_id", "c"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (parts := list(batches)):
            return
        rows = pa.Table.from_batches(parts)
        col = {k: column(rows, k) for k in (*kept, "n")}
        bits = np.stack([column(rows, w) for w in BITS], 1).view(tb.U)
        alive = np.zeros(rows.num_rows, bool)
        for askers, members in cells(col):
            for i, j in may_link(col["n"], col["c"], bits, askers, members):
                alive[i] = alive[j] = True
        yield from rows.select(kept).filter(pa.array(alive)).to_batches()

    return dealt.select(*kept, "n", *BITS).mapInArrow(run, "grp long, down int, across int, member boolean, doc_id long, c long")


def links_in_cells(dealt: DataFrame) -> DataFrame:
    """(a, b): of the links between components in each cell as many as connect them."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (parts := list(batches)):
            return
        rows = pa.Table.from_batches(parts)
        col = {k: column(rows, k) for k in ("grp", "down", "across", "member", "doc_id", "c")}
        sets = [np.frombuffer(x, tb.U) for x in rows.column("tokens").to_pylist()]
        n = np.array([len(x) for x in sets])
        bits = bitmaps(sets)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        found = []
        for askers, members in cells(col):
            for i, j in may_link(n, col["c"], bits, askers, members):
                for x, y, p, q in zip(i.tolist(), j.tolist(), col["c"][i].tolist(), col["c"][j].tolist()):
                    p, q = find(p), find(q)
                    if p != q and alike(sets[x], sets[y]):
                        root[max(p, q)] = min(p, q)
                        found.append(sorted((int(col["doc_id"][x]), int(col["doc_id"][y]))))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.select("grp", "down", "across", "member", "doc_id", "c", "tokens").mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, sets: DataFrame, hot: np.ndarray, copies: DataFrame) -> DataFrame:
    """(v, c): classes that link with another, and their component's smallest doc_id.

    docs: one row of each doc_id. sets: one row of each class. copies: doc_ids that represent no class.
    """
    spark = docs.sparkSession
    near = candidates(sets, star_pairs(sets))
    comp = components(links_of(near, tokens_of(docs, of_both(near))))
    marks = keep(comp.select(F.col("v").alias("doc_id"), "c", F.lit(False).alias("copy")).unionByName(copies.select("doc_id", F.lit(None).cast("long").alias("c"), F.lit(True).alias("copy"))), "marks")
    marked = ids_join(docs, marks, "doc_id", "left").where("doc_id is not null and not coalesce(copy, false)").withColumn("c", F.coalesce("c", "doc_id"))
    tokens = sets.agg(F.sum(F.expr(f"n * {100 - PERCENT} div 100 + 1"))).first()[0] or 0
    buckets = max(partitions(spark), -(-32 * tokens // BUCKET_BYTES))
    asks = keep(qualify(witnesses(marked, hot, buckets).repartitionById(buckets, F.col("bucket"))).distinct(), "asks")

    labels = comp.select(F.col("v").alias("doc_id"), "c")
    rows = asks.join(labels, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    rows = keep(rows.join(sets.select("doc_id", "n", *BITS), "doc_id"), "rows")
    of_group = [F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("only"), F.min("c").alias("low"), F.max("c").alias("high"), F.min("n").alias("least_n"), F.max("n").alias("n")]
    unions = keep(rows.where("member").groupBy("grp").agg(*of_group, *(F.bit_or(w).alias(w) for w in BITS)), "unions")
    opened = rows.where("not member").alias("q").join(unions.alias("g"), F.col("q.grp") == F.col("g.grp"))
    opened = opened.where(union_allows("q", "g") & ((F.col("q.c") != F.col("g.low")) | (F.col("q.c") != F.col("g.high"))) & ((F.col("g.members") > 1) | near_enough("q", "g")))
    opened = keep(opened.select("q.*", "members", "only"), "opened")
    alone = opened.where("members = 1 and doc_id <> only").select(F.least("doc_id", "only").alias("a"), F.greatest("doc_id", "only").alias("b"))
    near = candidates(sets, alone.distinct())

    sizes = opened.where("members > 1").groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("downs"), F.ceil(F.first("members") / CELL).cast("int").alias("acrosses"), F.count(F.lit(1)).alias("askers"), F.first("members").alias("members"))
    sizes = keep(sizes, "sizes")

    shape = ["grp", "downs", "acrosses"]
    many = opened.where("members > 1").drop("members", "only").join(sizes.select(shape), "grp").withColumn("down", F.pmod(F.xxhash64("doc_id"), "downs").cast("int"))
    many = many.withColumn("across", F.explode(F.expr("sequence(0, acrosses - 1)")))
    asked = rows.where("member").join(sizes.select(shape), "grp").withColumn("across", F.pmod(F.xxhash64("doc_id"), "acrosses").cast("int"))
    asked = asked.withColumn("down", F.explode(F.expr("sequence(0, downs - 1)")))
    n_rows = sizes.agg(F.sum(F.expr("askers * acrosses + members * downs"))).first()[0] or 0
    cell = [F.col(k) for k in ("grp", "down", "across")]
    alive = many.unionByName(asked).repartition(max(partitions(spark), -(-200 * n_rows // BUCKET_BYTES)), *cell)
    alive = keep(still_alive(alive), "alive")
    tokens = tokens_of(docs, of_both(near).union(alive.select("doc_id")))
    n_bytes = alive.join(tokens.select("doc_id", F.length("tokens").alias("size")), "doc_id").agg(F.sum("size")).first()[0] or 0
    whole = alive.join(tokens, "doc_id").repartition(max(partitions(spark), -(-n_bytes // BUCKET_BYTES)), *cell)
    links = keep(links_of(near, tokens).unionByName(links_in_cells(whole)), "links")
    comp = merged(comp, links)
    discard(asks, marks, rows, unions, opened, near, sizes, alive, tokens, links)
    return comp


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (see dedup) for every row.

    Null, empty and blank texts have no shingle and are components of their own; texts of any length count whole.
    Rows that repeat a doc_id are one document, with the least of their texts, and all get its result. A row
    without a doc_id has its shingles counted, links with nothing and has no component_id.
    """
    rows = docs.select("doc_id", "text")
    docs, repeated = single(rows)
    sums = keep(summarise(docs), "sums")
    hot = frequent(sums.where("hot"))
    sums = sums.where("not hot").drop("hot")
    own = sums.select("doc_id", "n", "s1", "s2").where("n > 0 and doc_id is not null")
    several = own.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    copies = keep(own.join(keep(several, "several"), ["n", "s1", "s2"]).where("doc_id <> rep").select("doc_id", "rep"), "copies")
    sets = keep(ids_join(sums.where("n > 0 and doc_id is not null"), copies.select("doc_id"), "doc_id", "left_anti", size=copies.count()), "sets")
    comp = linked(docs, sets, hot, copies)
    top = copies.join(comp.select(F.col("v").alias("rep"), "c"), "rep", "left").select("doc_id", F.coalesce("c", "rep").alias("c"))
    top = keep(top.unionByName(comp.select(F.col("v").alias("doc_id"), "c")), "top")
    out = ids_join(sums.select("doc_id", "n"), top, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
    if repeated:
        out = rows.select("doc_id").where("doc_id is not null").join(out, "doc_id").unionByName(out.where("doc_id is null"))
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id, and one row of each doc_id; a null doc_id stays.

    Equal sets are linked, empty texts with nothing. Rows that repeat a doc_id are one document: the row with the
    least text stays, of equal texts the one whose columns come first as JSON.
    """
    found = classes(docs)
    gone = keep(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    out = ids_join(docs, gone, "doc_id", "left_anti")
    repeated = keep(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.take(1):
        place = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))
        one = ids_join(out, repeated, "doc_id").withColumn("__place", F.row_number().over(place)).where("__place = 1").select(docs.columns)
        out = ids_join(out, repeated, "doc_id", "left_anti").unionByName(one)
    return out
