"""Byte-level BPE by backtracking over dictionary matches.

Bytes are taken as Latin-1 letters, so that an Aho-Corasick automaton of the vocabulary finds every
token in a piece in one pass. Encoding then goes left to right with the longest token at each place; a
token may follow another only if merging their joined bytes gives just these two, which is looked up in
a memo. When nothing fits, the last token gives way to its next shorter prefix, and a place that failed
is never entered again, so the work is linear in the piece. Neighbours that are all compatible are what
the merges by rank produce, and there is only one such sequence.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb
from .common import tidied

CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MOST_CACHED = 500_000
_codecs: dict[tuple[str, str], "Codec"] = {}


class Codec(dict):
    """Encodes texts by a rank file and decodes ids. As a dict: pieces met so far and their ids as bytes (bounded)."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.memo: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}  # of a token: what its last merge joined
        self.automaton = ahocorasick.Automaton()
        for t, r in self.ranks.items():
            if len(t) > 1:
                two = self.merged(t, 2)
                if len(two) != 2 or self.merged(t, 1) != [t]:
                    continue  # merges never make it: only ever a whole piece
                self.halves[r] = (self.ranks[two[0]], self.ranks[two[1]])
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()

    def merged(self, piece: bytes, least: int) -> list[bytes]:
        """Merges by rank, one at a time, down to ``least`` parts; for single tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """May token b follow token a, that is, do merges of their joined bytes give these two?

        Undo the merges inside a and b, latest first, and see whether the parts beside the border would
        have been joined before the merge that was undone.
        """
        before = 1 << 60
        while True:
            joint = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joint is not None and joint < before:
                return False
            if a in self.halves and (a > b or b not in self.halves):
                before, a = a, self.halves[a][1]
            elif b in self.halves:
                before, b = b + 1, self.halves[b][0]  # of equal ranks the left one merges first
            else:
                return True

    def ok(self, a: int, b: int) -> bool:
        got = self.memo.get(a << 24 | b)
        if got is None:
            if len(self.memo) > 2 * MOST_CACHED:
                self.memo.clear()
            got = self.memo[a << 24 | b] = self.fits(a, b)
        return got

    def backtrack(self, piece: bytes) -> list[int]:
        letters = piece.decode("latin-1")
        longest = {last + 1 - t[0]: t for last, t in self.automaton.iter(letters)}
        at, before, out = 0, -1, []
        while at < len(piece):  # most pieces need no step back
            n, token = longest[at]
            if before >= 0 and not self.ok(before, token):
                return self.step_back(letters)
            out.append(token)
            before = token
            at += n
        return out

    def step_back(self, letters: str) -> list[int]:
        found: list[list[tuple[int, int]]] = [[] for _ in letters]  # tokens that begin here, short ones first
        for last, t in self.automaton.iter(letters):
            found[last + 1 - t[0]].append(t)
        dead = bytearray(len(letters) + 1)
        starts, out, left = [0], [], [len(found[0])]  # tokens so far, and how many of each place's matches are untried
        while True:
            at, k = starts[-1], left[-1]
            while k:
                k -= 1
                n, token = found[at][k]
                if not dead[at + n] and (not out or self.ok(out[-1], token)):
                    break
            else:
                dead[at] = 1
                starts.pop()
                left.pop()
                out.pop()
                continue
            left[-1] = k
            out.append(token)
            if at + n == len(letters):
                return out
            starts.append(at + n)
            left.append(len(found[at + n]))

    def __missing__(self, piece: str) -> bytes:
        b = piece.encode()
        got = np.array([self.ranks[b]] if b in self.ranks else self.backtrack(b), "<u4").tobytes()
        if len(self) > MOST_CACHED:
            self.clear()
        if len(piece) < 64:
            self[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join([self[p] for p in self.pieces(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    """The codec of this Python worker, built once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary) of whole texts; a null text is empty and has no ids. One row for each row."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text binary): the bytes that ids stand for."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for b in batches:
            out = [c.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass, and keep counts and digests only, so that ids never leave the task."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids)), pa.array([sha(c.decode(x)) for x in ids])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, CODED)
