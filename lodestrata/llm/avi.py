"""AVI motion-JPEG: RIFF indexes, intra frames, shots.

Reading goes through the file's chunks: headers, idx1 or OpenDML ix## indexes (a walk over movi where a
file has none), and JPEG frames, baseline (SOF0) or lossless (SOF3), of any Huffman tables. Shots begin
where the histogram of a frame differs from the one before by more than the differences around it let
expect. The writer stores bytes losslessly, one byte a sample, as grey lossless JPEG frames with a
predictor; its Huffman table gives every difference nine bits, code and value together, so that both
directions are whole-array operations.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb
from .common import tidied

SIDE, FPS, BINS = 64, 25, 16
CLIP = "clip int, start_frame int, end_frame int, start_s double, end_s double, key_difference double"
SIZES = tuple(range(8, -1, -1))  #: categories of differences, the one with the shortest code (1 bit) first
# The zigzag order of a JPEG block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def canonical(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits) of a JPEG Huffman table: how many codes of 1 to 16 bits, and the symbols in order."""
    out, code, i = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for s in symbols[i : i + n]:
            out[s] = (code, bits)
            code += 1
        i += n
        code <<= 1
    return out


OWN_LENGTHS = [1] * 9 + [0] * 7
OWN = canonical(OWN_LENGTHS, list(SIZES))


def nine_bits() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit words of the differences -255 to 255, and the difference of each word."""
    word = np.zeros(511, np.uint16)
    back = np.zeros(512, np.int16)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, _ = OWN[size]
        word[d + 255] = code << size | (d if d >= 0 else d + (1 << size) - 1)
        back[word[d + 255]] = d
    return word, back


WORD, BACK = nine_bits()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_frame(pixels: np.ndarray) -> bytes:
    """Lossless JPEG of 8-bit grey samples, each predicted by its left neighbour (in a row's first place: the one above)."""
    x = pixels.astype(np.int16)
    d = np.empty_like(x)
    d[:, 1:] = x[:, 1:] - x[:, :-1]
    d[1:, 0] = x[1:, 0] - x[:-1, 0]
    d[0, 0] = x[0, 0] - 128
    words = WORD[d.ravel() + 255]
    words = np.concatenate([words, np.full(-len(words) % 8, 511, np.uint16)]).astype(np.uint64).reshape(-1, 8)
    bits = np.zeros((len(words), 9), np.uint8)  # eight words are nine bytes
    for j in range(9):
        first, last = 8 * j // 9, (8 * j + 7) // 9
        for k in range(first, last + 1):
            shift = 9 * (k + 1) - 8 * (j + 1)
            bits[:, j] |= (words[:, k] << np.uint64(-shift) if shift < 0 else words[:, k] >> np.uint64(shift)).astype(np.uint8)
    used = -(-9 * pixels.size // 8)
    scan = bits.tobytes()[:used].replace(b"\xff", b"\xff\x00")
    h, w = pixels.shape
    return b"".join((
        b"\xff\xd8", segment(0xC3, struct.pack(">BHHB", 8, h, w, 1) + b"\x01\x11\x00"), segment(0xC4, bytes([0, *OWN_LENGTHS, *SIZES])),
        segment(0xDA, b"\x01\x01\x00\x01\x00\x00"), scan, b"\xff\xd9",
    ))


class Bits:
    """A scan's bits without its stuffed zeros."""

    def __init__(self, scan: bytes):
        self.data = scan.replace(b"\xff\x00", b"\xff")
        self.at = self.have = self.acc = 0

    def need(self, n: int) -> None:
        while self.have < n:
            self.acc = (self.acc & ((1 << self.have) - 1)) << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.have += 8

    def take(self, n: int) -> int:
        self.need(n)
        self.have -= n
        return self.acc >> self.have & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for bits in range(1, 17):
            code = code << 1 | self.take(1)
            if (s := table.get((bits, code))) is not None:
                return s
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def basis() -> np.ndarray:
    k = np.arange(8)
    c = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


# Fixed values of the JPEG standard (tables K.3 to K.6), which frames of motion JPEG mean by having no tables of their own: how many
# codes there are of each length, and the symbols of the shorter ones. All other (run, size) symbols follow in order, in 16 bits.
DC_LENGTHS = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0])
AC_LENGTHS = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119])
AC_FIRST = (
    bytes.fromhex("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    bytes.fromhex("00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
)


def standard_tables() -> dict[int, dict[int, tuple[int, int]]]:
    symbols = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    out = {}
    for i in range(2):
        out[i] = canonical(DC_LENGTHS[i], list(range(12)))
        out[0x10 | i] = canonical(AC_LENGTHS[i], [*AC_FIRST[i], *sorted(set(symbols) - set(AC_FIRST[i]))])
    return out


STANDARD = standard_tables()


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Grey samples of an intra frame: of a colour frame its first component. Raises ValueError for other kinds of JPEG.

    Huffman tables that a frame doesn't bring are the standard's.
    """
    at, quant, huff, restart, parts = 2, {}, dict(STANDARD), 0, []
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker in (0xC0, 0xC1, 0xC3):
            kind, (bits, height, width, n) = marker, struct.unpack(">BHHB", body[:6])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if bits != 8:
                raise ValueError("samples of other than 8 bits")
        elif marker == 0xC4:
            while body:
                lengths = list(body[1:17])
                symbols = list(body[17 : 17 + sum(lengths)])
                huff[body[0]] = canonical(lengths, symbols)
                body = body[17 + sum(lengths) :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
        elif 0xC0 < marker < 0xD0:
            raise ValueError("progressive or arithmetic JPEG")
    tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    end = jpeg.rfind(b"\xff\xd9")
    scan = jpeg[at : end if end >= at else len(jpeg)]
    if kind == 0xC3:
        return lossless(scan, height, width, huff[tables[parts[0][0]] & 0xF0], body[-3])
    back = {k: {(b, c): s for s, (c, b) in t.items()} for k, t in huff.items()}
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
        across = down = 1
    cols, rows = -(-width // (8 * across)), -(-height // (8 * down))
    _, h0, v0, q0 = parts[0]
    blocks = np.zeros((rows * v0, cols * h0, 64), np.float32)
    chunks = split_restarts(scan) if restart else [scan]
    bits, before, chunk = Bits(chunks[0]), [0] * len(parts), 0
    for unit in range(rows * cols):
        if restart and unit and unit % restart == 0:
            chunk += 1
            bits, before = Bits(chunks[chunk]), [0] * len(parts)
        for i, (name, h, v, _) in enumerate(parts):
            dc, ac = back[tables[name] >> 4], back[0x10 | tables[name] & 15]
            for y in range(v):
                for x in range(h):
                    before[i] += bits.value(bits.symbol(dc))
                    to = blocks[unit // cols * v0 + y, unit % cols * h0 + x] if not i else np.zeros(64)
                    to[0] = before[i]
                    k = 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if not s:
                            break
                        k += s >> 4
                        if s & 15:
                            to[ZIGZAG[k]] = bits.value(s & 15)
                        k += 1
    table = np.zeros(64, np.float32)
    table[ZIGZAG] = quant[q0]
    c = basis()
    grid = (blocks * table).reshape(*blocks.shape[:2], 8, 8)
    full = np.clip(np.rint(c.T @ grid @ c + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(rows * v0 * 8, cols * h0 * 8)
    return full[: -(-height * v0 // down), : -(-width * h0 // across)]


def split_restarts(scan: bytes) -> list[bytes]:
    out, at, start = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0:
        if 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[start:at])
            start = at + 2
        at += 2
    return [*out, scan[start:]]


def lossless(scan: bytes, height: int, width: int, table: dict[int, tuple[int, int]], predictor: int) -> np.ndarray:
    """Samples of a lossless scan of one component with predictor 1 (left) and no point transform."""
    if predictor != 1:
        raise ValueError("other predictors than the left neighbour")
    n = height * width
    if table == OWN:
        raw = np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8)
        raw = np.concatenate([raw, np.zeros(-len(raw) % 9, np.uint8)]).reshape(-1, 9).astype(np.uint16)
        words = np.empty((len(raw), 8), np.uint16)
        for k in range(8):
            words[:, k] = (raw[:, k] << (k + 1) | raw[:, k + 1] >> (7 - k)) & 511
        d = BACK[words.ravel()[:n]]
    else:
        bits, back = Bits(scan), {(b, c): s for s, (c, b) in table.items()}
        d = np.array([bits.value(bits.symbol(back)) for _ in range(n)], np.int16)
    d = d.reshape(height, width).astype(np.int32)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return (np.cumsum(d, 1) & 255).astype(np.uint8)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, note: str = "", fps: int = FPS) -> bytes:
    """An AVI file of one MJPG stream with an idx1 index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", note.encode() + b"\0")) if note else b""
    body, index, at = [], [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        body.append(chunk(b"00dc", f))
        at += len(body[-1])
    return chunk(b"RIFF", b"AVI " + head + info + chunk(b"LIST", b"movi" + b"".join(body)) + chunk(b"idx1", b"".join(index)))


def walk(data: bytes, at: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, size) of each chunk; a chunk cut short ends the walk."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        stop = min(end, at + 8 + size)
        if name in (b"RIFF", b"LIST"):
            yield from walk(data, at + 12, stop, (*path, data[at + 8 : at + 12]))
        else:
            yield (*path, name), at + 8, stop - at - 8
        at = at + 8 + size + (size & 1)


def read_avi(data: bytes) -> dict:
    """fps, size, note and the (start, size) of the first video stream's frames, by its index."""
    out = {"fps": float(FPS), "width": 0, "height": 0, "note": "", "frames": [], "index": "none"}
    movi = listed = None
    seen, old, new = [], [], []
    for path, at, size in walk(data, 0, len(data)):
        name = path[-1]
        if name == b"avih":
            out["fps"] = 1e6 / max(1, struct.unpack_from("<I", data, at)[0])
            out["width"], out["height"] = struct.unpack_from("<II", data, at + 32)
        elif name == b"ICMT":
            out["note"] = data[at : at + size].rstrip(b"\0").decode("utf-8", "replace")
        elif name == b"idx1":
            old = [struct.unpack_from("<4sIII", data, at + i) for i in range(0, size - 15, 16)]
        elif name[:2] == b"ix" and size >= 24:
            n, base = struct.unpack_from("<I", data, at + 4)[0], struct.unpack_from("<Q", data, at + 12)[0]
            new += [(base + o, s & 0x7FFFFFFF) for o, s in (struct.unpack_from("<II", data, at + 24 + 8 * i) for i in range(n))]
        if b"movi" in path and name[2:] in (b"dc", b"db"):
            movi = at - 12 if movi is None else movi  # where the list's name stands
            seen.append((at, size))
    if new:
        out["frames"], out["index"] = new, "ix"
    elif old and movi is not None:
        shift = movi if any(n[2:] in (b"dc", b"db") and data[movi + o : movi + o + 4] == n for n, _, o, _ in old[:1]) else 0
        listed = [(shift + o + 8, s) for n, _, o, s in old if n[2:] in (b"dc", b"db")]
        out["frames"], out["index"] = listed, "idx1"
    else:
        out["frames"] = seen
    return out


def differences(frames: list[np.ndarray]) -> np.ndarray:
    """Half the summed distance of neighbours' histograms (0 to 1); the first is 0."""
    hist = np.array([np.bincount(f.ravel() // (256 // BINS), minlength=BINS) / f.size for f in frames])
    return np.r_[0, np.abs(np.diff(hist, axis=0)).sum(1) / 2]


def shots(d: np.ndarray, around: int = 12, factor: float = 3.0, least: float = 0.08) -> list[tuple[int, int, float]]:
    """(first frame, end, difference) of each shot: a cut is a difference over ``least`` and over the mean plus ``factor`` deviations of those around it."""
    n = len(d)
    at = np.arange(n)
    lo, hi = np.maximum(at - around, 1), np.minimum(at + around + 1, n)
    s, q = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    k = np.maximum(hi - lo - 1, 1)
    mean = (s[np.maximum(hi, lo)] - s[lo] - d) / k
    var = np.maximum((q[np.maximum(hi, lo)] - q[lo] - d * d) / k - mean**2, 0)
    cuts = np.flatnonzero((d > least) & (d > mean + factor * np.sqrt(var)) & (at > 0))
    edges = [0, *cuts.tolist(), n]
    return [(a, b, round(float(d[a]), 6)) for a, b in zip(edges, edges[1:]) if b > a]


def clips_of(data: bytes) -> list[tuple[int, int, int, float, float, float]]:
    """Timed clips of a file; one that has no readable frame has none."""
    info = read_avi(data)
    frames = [decode_frame(data[a : a + n]) for a, n in info["frames"] if n]
    return [(i, a, b, round(a / info["fps"], 6), round(b / info["fps"], 6), d) for i, (a, b, d) in enumerate(shots(differences(frames)))] if frames else []


def store(payload: bytes) -> bytes:
    """An AVI of the payload's bytes as samples, 64 in a line; the last frame's missing lines are zeros and its note has the length."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    high = min(SIDE, len(lines))
    lines = np.concatenate([lines, np.zeros((-len(lines) % high, SIDE), np.uint8)])
    return write_avi([encode_frame(x) for x in lines.reshape(-1, high, SIDE)], SIDE, high, f"payload {len(payload)}")


def restore(data: bytes) -> tuple[bytes, list[np.ndarray]]:
    info = read_avi(data)
    frames = [decode_frame(data[a : a + n]) for a, n in info["frames"]]
    return b"".join(f.tobytes() for f in frames)[: int(info["note"].split()[1])], frames


def padded(text: bytes) -> bytes:
    return text + b"\0" * ((-len(text) % 64) if text else 64)


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): every whole text as an AVI file; a null text is empty."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([store(padded((t or "").encode())) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def clips(files: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Timed clip rows of AVI files in a binary column; null files, and files that aren't readable, have none (see problems)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(k, *c) for c in clips_of(data or b"")]
                except (ValueError, IndexError, KeyError, struct.error):
                    continue
            kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[key, "clip", "start_frame", "end_frame", "start_s", "end_s", "key_difference"])

    return files.select(key, column).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, {CLIP}")


def problems(files: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, problem): why files have no clip rows; 'no file' for a null, 'no frame' for an AVI without any. A file is here or in clips()."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if data is None:
                    found.append((k, "no file"))
                    continue
                try:
                    if not clips_of(data):
                        found.append((k, "no frame"))
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    found.append((k, f"{type(e).__name__}: {e}"))
            cols = list(zip(*found)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string())], names=[key, "problem"])

    return files.select(key, column).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, problem string")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, n_clips int"


def digest(text: str | None) -> tuple:
    raw = (text or "").encode()
    file = store(padded(raw))
    payload, frames = restore(file)
    d = differences(frames)
    cut = shots(d)
    feature = f"frames={len(frames)};clips=" + ",".join(f"{a / FPS:.2f}-{b / FPS:.2f}@{x:.4f}" for a, b, x in cut) + f";mean={float(np.mean(d)):.6f};max={float(np.max(d)):.6f}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature, len(frames), len(cut)


def digests(docs: DataFrame) -> DataFrame:
    """Store every whole text, read the stored bytes back and keep digests and features, one row for each row.

    The feature lists all clips; n_clips counts them. Equal texts have equal values. A null text is an empty one, which is stored
    as 64 zeros; texts of any length are stored whole, in as many frames as they need. Rows that repeat a doc_id, or have none, have
    a row each; other columns are left out.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                cols = zip(*map(digest, b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
