"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Spark sorts the pieces by range of length, and a piece is known by its length and its rank among equal
lengths. A round sorts open documents and gaps by size and sweeps them together: every gap gets the
longest document that it can hold, and for equal sizes ranks resolve the conflicts. Then the gaps
shrink and the next round begins. Pieces of one length, and gaps of one room, differ in their ranks
only. So the sweep runs over counts that the range partitions add up (there are at most as many sizes as
tokens in a sequence, whatever the data), a match is a run of ranks, and every task places its own rows
from these runs: rows cross the network once, in the sort, however many rounds there are.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textbytes as tb
from .common import keep, tidied

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MOST_CACHED = 250_000
#: A lower-case Latin-1 word and the marks behind it; of such a part the vocabulary's rules make these two tokens' worth of text.
PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
_state: dict = {}


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


class Encoder(dict):
    """Ids of whole texts as little-endian 32-bit integers, without special tokens.

    This vocabulary drops white space and never merges across it, so that the parts between white space
    are looked up in a bounded cache and only new ones go to the tokenizer; new parts that are a plain
    word with marks go to its merges directly. Texts with one of the four control characters that Python
    alone takes for white space are encoded in one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.merges = self.whole.model.tokenize
        self.letters = byte_letters()

    def word(self, w: str) -> bytes:
        if (got := self.get(w)) is None:
            spelt = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
            got = self[w] = np.array([t.id for t in self.merges(spelt)], "<u4").tobytes()
        return got

    def full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, p: str) -> bytes:
        if m := PLAIN.fullmatch(p.lower()):
            got = self.word(m[1]) + (self.word(m[2]) if m[2] else b"")
        else:
            got = self.full(p)
        self[p] = got
        return got

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.full(text)
        if len(self) > MOST_CACHED:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> Encoder:
    if path not in _state:
        _state.clear()
        _state[path] = Encoder(path)
    return _state[path]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """Every document's ids with end_id behind them, cut at multiples of ``size``.

    A null or empty text is the single end_id. A repeated doc_id gives its pieces once for each row.
    """
    end = np.array([end_id], "<u4").tobytes()

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary)
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                rows = []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = ids_of(t or "") + end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def ranked(df: DataFrame, size: str) -> tuple[DataFrame, np.ndarray]:
    """df range-sorted by size, with each row's ``part`` and its ``rank`` among the rows of its size there; the counts (size, part, rows).

    A range partition holds a run of sizes, and several partitions may share a size with very many
    rows, so that all partitions together have about as many counts as there are sizes.
    """

    @tidied
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, seen = -1, 0
        for b in batches:
            sizes = b.column(size).to_numpy()
            if not len(sizes):
                continue
            runs = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]])
            lens = np.diff(np.r_[runs, len(sizes)])
            rank = np.arange(len(sizes)) - np.repeat(runs, lens)
            if sizes[0] == last:
                rank[: lens[0]] += seen
            seen = int(rank[-1]) + 1
            last = sizes[-1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(rank)], names=[*b.schema.names, "part", "rank"]
            )

    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())])
    ties = [c for c in df.columns if c != size]
    out = keep(df.repartitionByRange(size, *ties).sortWithinPartitions(size).mapInArrow(number, schema), "ranked")
    counts = sorted(tuple(r) for r in out.groupBy(size, "part").count().collect())
    return out, np.array(counts, np.int64).reshape(-1, 3)


def sweep(docs: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Match runs of gaps with runs of documents: (room, first gap, length, first document, how many).

    Gaps go up by room; each takes one of the longest documents that are left and fit. Ranks resolve
    conflicts: the n-th of the gaps of a run gets the n-th of the documents.
    """
    stack: list[list[int]] = []
    lengths = sorted(docs)
    out, i = [], 0
    for room in sorted(gaps):
        while i < len(lengths) and lengths[i] <= room:
            stack.append([lengths[i], 0, docs[lengths[i]]])
            i += 1
        first, left = 0, gaps[room]
        while left and stack:
            top = stack[-1]
            n = min(left, top[2] - top[1])
            out.append((room, first, top[0], top[1], n))
            top[1] += n
            first += n
            left -= n
            if top[1] == top[2]:
                stack.pop()
    return out


SHIFT = 40  #: of a size above a rank in one 64-bit key


class Plan:
    """All rounds, as runs of ranks.

    Long documents go first: a band holds the lengths over half of the longest that is open. Rounds of
    sweeps place a band; when none of it fits, its longest documents open as many sequences as the
    tokens that are left in the band fill. ``placed`` has runs of documents: length and first rank as a
    key, how many, the round, the gap's room (-1: it opens a sequence), the first gap's rank or the first
    sequence. ``moved`` has for each round the runs of gaps whose room or ranks change: the new key, how
    many, the room and first rank before (-1 and the first sequence for opened ones).
    """

    def __init__(self, counts: dict[int, int], size: int):
        docs, used = dict(counts), dict.fromkeys(counts, 0)
        gaps: dict[int, int] = {}
        placed, self.moved, self.sequences = [], [], 0
        while docs:
            band = {k: v for k, v in docs.items() if k > max(docs) // 2}
            docs = {k: v for k, v in docs.items() if k not in band}
            while band:
                runs, t = sweep(band, gaps), len(self.moved)
                if runs:
                    taken, change = {}, []
                    for room, _, _, _, n in runs:
                        taken[room] = taken.get(room, 0) + n
                    for room, n in taken.items():
                        if gaps[room] > n:
                            change.append((room << SHIFT, gaps[room] - n, room, n))
                        gaps[room] -= n
                    for room, first, length, rank, n in runs:
                        placed.append((length << SHIFT | used[length] + rank, n, t, room, first))
                        if rest := room - length:
                            change.append((rest << SHIFT | gaps.get(rest, 0), n, room, first))
                            gaps[rest] = gaps.get(rest, 0) + n
                    for _, _, length, _, n in runs:
                        band[length] -= n
                        used[length] += n
                else:
                    change, due = [], -(-sum(k * v for k, v in band.items()) // size)
                    for length in sorted(band, reverse=True):
                        n = min(due, band[length])
                        placed.append((length << SHIFT | used[length], n, t, -1, self.sequences))
                        if rest := size - length:
                            change.append((rest << SHIFT | gaps.get(rest, 0), n, -1, self.sequences))
                            gaps[rest] = gaps.get(rest, 0) + n
                        band[length] -= n
                        used[length] += n
                        self.sequences += n
                        due -= n
                        if not due:
                            break
                band = {k: v for k, v in band.items() if v}
                gaps = {k: v for k, v in gaps.items() if v}
                self.moved.append(np.array(sorted(change), np.int64).reshape(-1, 4))
        self.placed = np.array(sorted(placed), np.int64).reshape(-1, 5)
        self.size = size

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of documents, by following each one's gap back to the document that opened its sequence."""
        key = lengths << SHIFT | ranks
        run = self.placed[np.searchsorted(self.placed[:, 0], key, "right") - 1]
        at, room = run[:, 4] + key - run[:, 0], run[:, 3].copy()
        offset = np.where(room < 0, 0, self.size - room)
        for t in range(int(run[:, 2].max(initial=-1)) - 1, -1, -1):
            live = np.flatnonzero((room >= 0) & (run[:, 2] > t))
            moved = self.moved[t]
            if not len(live) or not len(moved):
                continue
            gap = room[live] << SHIFT | at[live]
            i = np.maximum(np.searchsorted(moved[:, 0], gap, "right") - 1, 0)
            hit = (gap >= moved[i, 0]) & (gap < moved[i, 0] + moved[i, 1])
            live, i, gap = live[hit], i[hit], gap[hit]
            room[live] = moved[i, 2]
            at[live] = moved[i, 3] + gap - moved[i, 0]
        return at, offset


def pack(found: DataFrame, size: int = 4096) -> DataFrame:
    """Give every piece (column ``length``, 1 to size) a ``sequence_id`` and an ``offset`` there; offsets are gapless from 0.

    An empty table gives an empty table; equal rows are placed one by one.
    """
    rows, counts = ranked(found, "length")
    spark = found.sparkSession
    total: dict[int, int] = {}
    bases = np.zeros(len(counts), np.int64)
    for i, (length, _, n) in enumerate(counts.tolist()):
        bases[i] = total.get(length, 0)
        total[length] = total.get(length, 0) + n
    sent = spark.sparkContext.broadcast((counts[:, 0] << 32 | counts[:, 1], bases, Plan(total, size)))

    @tidied
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, plan = sent.value
        for b in batches:
            lengths = b.column("length").to_numpy()
            at = base[np.searchsorted(keys, lengths << 32 | b.column("part").to_numpy().astype(np.int64))] if len(lengths) else lengths
            seq, offset = plan(lengths, at + b.column("rank").to_numpy())
            b = b.drop_columns(["part", "rank"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(offset)], names=[*b.schema.names, "sequence_id", "offset"])

    schema = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``size`` tokens."""
    return pack(keep(pieces(docs, vocabulary, end_id, size), "pieces"), size)
