"""Quality scores by co-training a text-content view and a page-metadata view.

Each view is a logistic regression over compact features of every document, kept once in the shared
folder. Newton steps are sums over rows, so that every round is one pass over all documents which
returns a few thousand numbers. In a round each view hands the other the unlabelled documents of which
it is sure, as pseudo-labels. At last a fifth of the labelled documents, which no view has learnt from,
calibrates each view and sets the weights of their sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import discard, keep, tidied

SURE = 0.98  #: of a pseudo-label, by the view that gives it
ROUNDS, FIRST_STEPS, STEPS = 2, 6, 3
KEPT_FROM = 0.3  #: a document stays from this probability of good quality on
ENDINGS, SOURCES, LANGS = 16, 16, 8
FEATURES = "doc_id long, text_view binary, page_view binary"
SCORED = "doc_id long, text_score double, page_score double, score double, keep boolean"


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between the borders ``at``."""
    return np.diff(np.r_[0, np.cumsum(values)][at]).astype(float)


def text_view(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Shares of kinds of letters, words and word endings, and how much words repeat."""
    n = np.maximum(np.diff(offs), 1)
    low = tb.LOWER[data]
    upper = low != data
    letter = (low >= 97) & (low <= 122)
    digit = (data >= 48) & (data <= 57)
    space = tb.SPACE[data]
    odd = ~letter & ~digit & ~space & (data < 128) & (data != 44) & (data != 46)
    out = [per_row(x, offs) / n for x in (upper, letter, digit, space, odd, data >= 128, data == 33, data == 124)]
    inner = ~space
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1] | edge[1:-1]
    last[:-1] &= ~inner[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = tb.Spans(low)(starts, ends)
    at = np.searchsorted(starts, offs)
    w = np.diff(at)
    safe = np.maximum(w, 1)
    rows = np.repeat(np.arange(len(w)), w)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((hashes, rows))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(hashes) else np.zeros(0)
    top = np.zeros(len(w))
    np.maximum.at(top, rows[order], size)
    out += [np.log1p(w), per_row(ends - starts, at) / safe, per_row(same, at) / safe, per_row(new, at) / safe / (1 + 0.1 * np.log1p(w)), top / safe, per_row(odd[ends - 1], at) / safe]
    ending = np.bincount(rows * ENDINGS + low[ends - 1] % ENDINGS, minlength=len(w) * ENDINGS).reshape(-1, ENDINGS) / safe[:, None]
    return np.concatenate([np.stack(out, 1), ending], 1).astype(np.float32)


def page_view(data: np.ndarray, offs: np.ndarray, n_chars: np.ndarray, source: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """What a page says without its words: declared length, source and language, and the layout of its lines."""
    n = np.diff(offs)
    line = data == 10
    lines = per_row(line, offs) + 1
    edge = np.unique(np.r_[offs[:-1], np.flatnonzero(line) + 1])
    edge = edge[edge < len(data)]
    lens = np.diff(np.r_[edge, len(data)])
    of = np.searchsorted(offs, edge, "right") - 1
    longest, short = np.zeros(len(n)), np.zeros(len(n))
    np.maximum.at(longest, of, lens)
    np.add.at(short, of, lens <= 30)
    sq = np.zeros(len(n))
    np.add.at(sq, of, lens.astype(float) ** 2)
    mean = n / lines
    out = [np.log1p(np.maximum(np.nan_to_num(n_chars.astype(float)), 0)), np.log1p(n), np.log1p(lines), np.log1p(mean), np.log1p(longest), short / lines, np.sqrt(np.maximum(sq / lines - mean**2, 0)) / np.maximum(mean, 1)]
    out = np.stack(out, 1)
    hot = [np.eye(SOURCES)[source % SOURCES], np.eye(LANGS)[lang % LANGS]]
    return np.concatenate([out, *hot], 1).astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """Both views of every document. A null text is empty, a null n_chars is 0, null sources and languages are a kind of their own."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                data, offs = tb.raw(b.column(1))
                t = text_view(data, offs)
                m = page_view(data, offs, *(b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([x.tobytes() for x in t], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())],
                    names=["doc_id", "text_view", "page_view"],
                )

    return docs.select("doc_id", "text", *page_parts(docs)).mapInArrow(run, FEATURES)


def page_parts(docs: DataFrame) -> list[Column]:
    """What a row's page view takes from other columns than text, under names of their own."""
    have = set(docs.columns)
    part = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(1 << 20)) if c in have else F.lit(0)
    n_chars = F.coalesce(F.col("n_chars").cast("long"), F.lit(0)) if "n_chars" in have else F.lit(0)
    return [n_chars.cast("long").alias("__n"), part("source").cast("long").alias("__s"), part("lang").cast("long").alias("__l")]


def matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), -1).astype(np.float64)


def total(table: DataFrame, rows: Callable[..., list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over the whole table of the arrays that ``rows`` makes of a batch (text view, page view, label, fold)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = None
        for b in batches:
            if not b.num_rows:
                continue
            got = rows(matrix(b.column(0)), matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False))
            one = np.concatenate([np.r_[float(g.ndim), [*g.shape, 0][:2], g.ravel()] for g in got])
            if flat is None:
                flat, heads = one, one.copy()
            else:
                flat = flat + one
            at = 0
            for g in got:  # heads stay as they are
                flat[at : at + 3] = heads[at : at + 3]
                at += 3 + g.size
        if flat is not None:
            at, keys, vals, k = 0, [], [], 0
            while at < len(flat):
                d, a, b_ = map(int, heads[at : at + 3])
                size = a * b_ if d == 2 else a
                keys.append(np.stack([np.full(size, k), np.full(size, a), np.full(size, b_ if d == 2 else 0), np.arange(size)], 1))
                vals.append(flat[at + 3 : at + 3 + size])
                at += 3 + size
                k += 1
            keys, vals = np.concatenate(keys), np.concatenate(vals)
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, j].astype(np.int32)) for j in range(4)), pa.array(vals)], names=["k", "a", "b", "i", "v"])

    sums = table.select("text_view", "page_view", "label", "fold").mapInArrow(run, "k int, a int, b int, i int, v double").groupBy("k", "a", "b", "i").agg(F.sum("v")).collect()
    out: dict[int, np.ndarray] = {}
    for k, a, b, i, v in sums:
        out.setdefault(k, np.zeros(a * b if b else a))[i] = v
    shape = {r[0]: (r[1], r[2]) if r[2] else (r[1],) for r in sums}
    return [out[k].reshape(shape[k]) for k in sorted(out)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sums_of(x: np.ndarray, y: np.ndarray, use: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Gradient, Hessian and count of the logistic loss at w."""
    x, y = x[use], y[use]
    p = sigmoid(x @ w)
    return [x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x, np.array([float(len(y))])]


def newton(w: np.ndarray, g: np.ndarray, h: np.ndarray, n: float, ridge: float = 1e-3) -> np.ndarray:
    penalty = np.full(len(w), ridge * n + 0.5)
    penalty[0] = 1e-6
    step = np.linalg.solve(h + np.diag(penalty + 1e-9), g + penalty * w)
    return w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))


class Views:
    """Scales and weights of both views, and how they are calibrated and summed."""

    def __init__(self, centre: list[np.ndarray], spread: list[np.ndarray]):
        self.centre, self.spread = centre, spread
        self.w = [np.zeros(len(c) + 1) for c in centre]
        self.platt = [np.array([0.0, 1.0]), np.array([0.0, 1.0])]
        self.both = np.array([0.0, 1.0, 1.0])

    def x(self, v: int, raw: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(raw), 1)), np.clip((raw - self.centre[v]) / self.spread[v], -8, 8)], 1)

    def z(self, v: int, raw: np.ndarray) -> np.ndarray:
        return np.clip(self.x(v, raw) @ self.w[v], -12, 12)

    def calibrated(self, v: int, raw: np.ndarray) -> np.ndarray:
        return self.platt[v][0] + self.platt[v][1] * self.z(v, raw)

    def score(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.calibrated(0, t), self.calibrated(1, m)
        return sigmoid(a), sigmoid(b), sigmoid(self.both[0] + self.both[1] * a + self.both[2] * b)


def co_train(table: DataFrame) -> Views:
    """table: text_view, page_view, label (0, 1 or -1 for none), fold (0 to 4; labels of fold 0 calibrate)."""
    moments = total(table, lambda t, m, y, f: [np.array([float(len(t))]), t.sum(0), (t * t).sum(0), m.sum(0), (m * m).sum(0), np.array([float((y == 1).sum()), float((y == 0).sum())])])
    if not moments:
        return Views([np.zeros(1), np.zeros(1)], [np.ones(1), np.ones(1)])
    n = moments[0][0]
    centre = [moments[1] / n, moments[3] / n]
    spread = [np.sqrt(np.maximum(s / n - c * c, 0)) for s, c in zip((moments[2], moments[4]), centre)]
    views = Views(centre, [np.where(s > 1e-9, s, 1) for s in spread])
    good, bad = moments[5]
    if not good or not bad:
        return views

    def learn(steps: int, pseudo: bool) -> None:
        teacher = Views(views.centre, views.spread)
        teacher.w = [w.copy() for w in views.w]
        for _ in range(steps):

            def rows(t, m, y, f, now=views, teacher=teacher):
                out = []
                for v, own, other in ((0, t, m), (1, m, t)):
                    use, label = (y >= 0) & (f > 0), y.astype(float)
                    if pseudo:
                        p = sigmoid(teacher.z(1 - v, other))
                        sure = (y < 0) & ((p >= SURE) | (p <= 1 - SURE))
                        use, label = use | sure, np.where(sure, p > 0.5, label)
                    out += sums_of(now.x(v, own), label, use, now.w[v])
                return out

            got = total(table, rows)
            for v in (0, 1):
                g, h, k = got[3 * v : 3 * v + 3]
                views.w[v] = newton(views.w[v], g, h, k[0])

    learn(FIRST_STEPS, pseudo=False)
    for _ in range(ROUNDS):
        learn(STEPS, pseudo=True)
    for _ in range(STEPS + 2):
        got = total(table, lambda t, m, y, f: [a for v, raw in ((0, t), (1, m)) for a in sums_of(np.stack([np.ones(len(y)), views.z(v, raw)], 1), y.astype(float), (y >= 0) & (f == 0), views.platt[v])])
        for v in (0, 1):
            views.platt[v] = newton(views.platt[v], *got[3 * v : 3 * v + 2], got[3 * v + 2][0])
    for _ in range(STEPS + 2):
        g, h, k = total(table, lambda t, m, y, f: sums_of(np.stack([np.ones(len(y)), views.calibrated(0, t), views.calibrated(1, m)], 1), y.astype(float), (y >= 0) & (f == 0), views.both))
        views.both = newton(views.both, g, h, k[0])
    return views


def learned(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, Views]:
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int")
    table = keep(features(docs).join(known, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(-1))).withColumn("fold", fold), "views")
    return table, co_train(table)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, each view's calibrated score, their combination, and whether the document stays.

    One row for each row of docs. Labels that are null or neither 0 nor 1 are none; of several for one doc_id
    the smallest counts. Without labels of both kinds every score is 0.5 and all documents stay. An
    empty text is scored by its features like any other.
    """
    table, views = learned(docs, labels, label)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, m, s = views.score(matrix(b.column(1)), matrix(b.column(2)))
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (a, m, s, s >= KEPT_FROM))], names=["doc_id", "text_score", "page_score", "score", "keep"])

    return table.select("doc_id", "text_view", "page_view").mapInArrow(run, SCORED)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are rejected, each judged by itself: of rows that repeat a doc_id some may go and others stay. A null doc_id stays."""
    table, views = learned(docs, labels, "quality")
    discard(table)
    given = docs.withColumns({f"__{i}": c for i, c in enumerate(page_parts(docs))})
    text, doc_id = docs.columns.index("text"), docs.columns.index("doc_id")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                data, offs = tb.raw(b.column(text))
                page = page_view(data, offs, *(c.to_numpy(zero_copy_only=False) for c in b.columns[-3:]))
                s = views.score(text_view(data, offs).astype(np.float64), page.astype(np.float64))[2]
                stays = (s >= KEPT_FROM) | b.column(doc_id).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(b.columns[:-3], names=b.schema.names[:-3]).filter(pa.array(stays))

    return given.mapInArrow(run, docs.schema)
