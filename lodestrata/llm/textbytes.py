"""Words and shingles of Arrow text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEPT = 1 << 19
_powers: dict[str, np.ndarray] = {}


def inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** j and BASE ** -j modulo 2 ** 64 for j up to n; those of longer texts aren't kept."""

    def table(b: int, size: int) -> np.ndarray:
        x = np.full(size, b, U)
        x[0] = 1
        with np.errstate(over="ignore"):
            return np.multiply.accumulate(x)

    bases = {"up": int(BASE), "down": inverse(int(BASE))}
    if n > KEPT:
        return table(bases["up"], n + 1), table(bases["down"], n + 1)
    if not _powers:
        _powers.update({k: table(b, KEPT + 1) for k, b in bases.items()})
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one to one)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; a null is empty."""
    col = pc.fill_null(col, "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]] if len(col) else np.zeros(0, np.uint8)
    return data, offs - offs[0] if len(offs) else np.zeros(1, np.int64)


def blocks(batch: pa.RecordBatch, column: str, most: int = 1 << 18):
    """Parts of a batch with at most ``most`` bytes of text, or a single longer row."""
    if not batch.num_rows:
        return
    i = batch.schema.get_field_index(column)
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which of 256 byte values lie in one of the ranges, both ends included."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


NOT_SPACE = ~SPACE


def inner_runs(data: np.ndarray, offs: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of ``inner`` bytes of a block's rows, where each row's begin (one more at the end), and which bytes are inner."""
    use = inner[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = use.copy(), use.copy()
    first[1:] &= ~use[:-1] | edge[1:-1]
    last[:-1] &= ~use[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs), use


def tokens(data: np.ndarray, offs: np.ndarray, inner: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """All maximal runs of ``inner`` bytes of a block's rows as one Arrow column, and where each row's begin (one more at the end).

    What is no inner byte must be ASCII, so that no character is cut. No Python object for a word.
    """
    starts, ends, at, use = inner_runs(data, offs, inner)
    places = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[use])), at


def coded(words: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """A number for each word, and the words by number."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


class Spans:
    """Hashes of any byte spans of a block by prefix sums.

    Equal spans have equal hashes. Different ones may collide by design of their texts, so that these hashes only propose.
    """

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each span as two columns: for what counts as equal by them, no one can write a second text."""
    view = memoryview(np.ascontiguousarray(data))
    one = hashlib.blake2b
    return np.frombuffer(b"".join([one(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())]), U).reshape(-1, 2)


PACKED = 16  #: bytes of words that are hashed as two 64-bit integers
MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U)


def words(data: np.ndarray, offs: np.ndarray, key: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a block, A-Z lower-cased, and where each row's words begin (one more at the end).

    Words of up to PACKED bytes are hashed by their bytes as integers, longer ones by BLAKE2b. With a key that whoever writes texts doesn't
    know, no two words can be made to collide.
    """
    low = LOWER[data]
    starts, ends, at, _ = inner_runs(low, offs, NOT_SPACE)
    n = ends - starts
    full = np.r_[low, np.zeros(PACKED, np.uint8)]
    eight = np.ndarray((len(full) - 7,), "<u8", full, strides=(1,))  # the eight bytes from each place on
    a, b, c = (U(k & 0xFFFFFFFFFFFFFFFF) for k in key)
    with np.errstate(over="ignore"):
        h = mix((eight[starts] & MASK[np.minimum(n, 8)]) ^ a)
        h = mix(h + ((eight[starts + 8 * (n > 8)] & MASK[np.clip(n - 8, 0, 8)]) ^ b))
        h = mix(h + (n.astype(U) ^ c))
    long = np.flatnonzero(n > PACKED)
    if len(long):
        secret = b"".join(int(k).to_bytes(8, "little") for k in (a, b, c))
        view = memoryview(low)
        h[long] = [int.from_bytes(hashlib.blake2b(view[s:e], digest_size=8, key=secret).digest(), "little") for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    return h, at


def shingles(col: pa.Array, k: int = 5, key: tuple[int, ...] = (1, 2, 3)) -> list[np.ndarray]:
    """Each row's distinct k-word shingles as sorted hashes; with fewer words the whole sequence is one."""
    data, offs = raw(col)
    if not len(col):
        return []
    hashes, at = words(data, offs, key)
    n = len(hashes) - k + 1
    with np.errstate(over="ignore"):
        if n > 0:
            s = hashes[:n].copy()
            for i in range(1, k):
                s = mix(s) + hashes[i : i + n]
            s = mix(s)
        out = []
        for lo, hi in zip(at[:-1], at[1:]):
            if hi - lo >= k:
                out.append(np.unique(s[lo : hi - k + 1]))
            elif hi > lo:
                x = U(hi - lo)
                for w in hashes[lo:hi]:
                    x = mix(x) + w
                out.append(mix(np.array([x], U)))
            else:
                out.append(np.zeros(0, U))
    return out
