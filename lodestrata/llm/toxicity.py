"""Toxicity scores by a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed vectors of the word and of its first bytes. Filters of several
widths run over the words of a whole text, each keeps its largest answer, and a logistic layer weighs
these. The first component of a hashed vector starts as the log odds of its bucket in one part of the
labelled sample, a second part trains filters and vectors, and a third sets, for each language, the
threshold that becomes 0.7. The language is guessed from the text's own function words: columns such as
lang, source or doc_id are never looked at by a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import discard, keep, tidied

SAMPLE = 6000  #: labelled documents that the classifier may learn from, at most
SAMPLE_CHARS = 60_000_000  #: characters that their texts may have together; longer texts beyond this are passed over whole
BITS, WIDTH, FILTERS, SPANS = 17, 8, 8, (1, 2, 3)
PREFIXES = (4, 5, 6)
STEPS = 300  #: of training, each on 64 documents, at least
PREDICTED_FROM = 0.7
# Common function words that tell languages apart.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine den dem des mit sich auf für von zu im auch",
    "en": "the of and to in is that it with for was on are as be this at by not from",
    "es": "el los las del que una por con para como más su al lo se y es",
    "fr": "le les des et que une pour dans qui sur au du la est pas ce ne",
}
LANGUAGES = (*sorted(FUNCTION_WORDS), "other")
SCORED = "doc_id long, held_out boolean, score double, predicted int, guessed_language string"


def letters(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the accented capitals of Latin-1 in UTF-8."""
    low = tb.LOWER[data]
    if len(low) > 1:
        up = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][up] += 32
    return low


def word_ids(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word (the word, its prefixes), the words' own hashes, and where each row's words begin."""
    data, offs = tb.raw(col)
    low = letters(data)
    inner = ((low >= 97) & (low <= 122)) | (low >= 0x80)
    edge = np.zeros(len(low) + 1, bool)
    edge[offs] = True
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1] | edge[1:-1]
    last[:-1] &= ~inner[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    spans = tb.Spans(low)
    whole = spans(starts, ends)
    shift = tb.U(64 - BITS)
    ids = [(whole >> shift).astype(np.int32)]
    for k in PREFIXES:
        with np.errstate(over="ignore"):
            h = tb.mix(spans(starts, np.minimum(starts + k, ends)) + tb.U(k))
        ids.append((h >> shift).astype(np.int32))
    return np.stack(ids, 1), whole, np.searchsorted(starts, offs)


_known: dict[str, np.ndarray] = {}


def languages(whole: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index in LANGUAGES of the language with most function words (ties: the first; none: other)."""
    counts = np.zeros((len(at) - 1, len(LANGUAGES)))
    counts[:, -1] = 0.5
    for j, lang in enumerate(LANGUAGES[:-1]):
        if lang not in _known:
            _known[lang] = np.sort(word_ids(pa.array(FUNCTION_WORDS[lang].split()))[1])
        known = _known[lang]
        hit = known[np.minimum(np.searchsorted(known, whole), len(known) - 1)] == whole
        counts[:, j] = np.diff(np.r_[0, np.cumsum(hit)][at])
    return counts.argmax(1)


class Net:
    """Vectors, filters of each width and the logistic layer."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.vectors = r.normal(0, 0.05, ((1 << BITS) + 1, WIDTH)).astype(np.float32)
        self.vectors[-1] = 0  # the pad between rows
        self.filters = {w: r.normal(0, 0.3, (w, WIDTH, FILTERS)).astype(np.float32) for w in SPANS}
        for w in SPANS:
            self.filters[w][:, 0, :] = np.abs(self.filters[w][:, 0, :]) + (1.0 if w == 1 else 0.3)
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in SPANS}
        self.out = np.full(len(SPANS) * FILTERS, 0.1, np.float32)
        self.base = np.float32(-1)
        self.cut = np.zeros(len(LANGUAGES))
        self.slope = 1.0

    def layout(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors with pads behind each row, and where rows begin.

        With as many pads as the widest filter, no window that begins with a row's word, or with the first pad of
        a row without words, reaches the next row.
        """
        gap = max(SPANS)
        rows = len(at) - 1
        starts = at[:-1] + gap * np.arange(rows)
        place = np.arange(len(ids)) + gap * np.repeat(np.arange(rows), np.diff(at))
        x = np.zeros((len(ids) + gap * rows + 1, WIDTH), np.float32)
        v = self.vectors[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            v += self.vectors[ids[:, k]]
        x[place] = v
        return x, starts

    def convolve(self, x: np.ndarray, w: int) -> np.ndarray:
        n = len(x) - max(SPANS) + 1
        y = x[:n] @ self.filters[w][0]
        for k in range(1, w):
            y += x[k : n + k] @ self.filters[w][k]
        return y + self.bias[w]

    def logits(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0, np.float32)
        x, starts = self.layout(ids, at)
        edges = np.stack([starts, starts + np.maximum(np.diff(at), 1)], 1).ravel()
        pooled = [np.maximum(np.maximum.reduceat(self.convolve(x, w), edges, 0)[::2], 0) for w in SPANS]
        return np.concatenate(pooled, 1) @ self.out + self.base

    def step(self, ids: np.ndarray, at: np.ndarray, y: np.ndarray, rate: float, past: dict) -> None:
        """One Adagrad step on a batch; of a filter only the window with its largest answer gets a gradient."""
        x, starts = self.layout(ids, at)
        stops = starts + np.maximum(np.diff(at), 1)
        best, pooled = {}, []
        for w in SPANS:
            z = self.convolve(x, w)
            best[w] = np.stack([a + z[a:b].argmax(0) for a, b in zip(starts, stops)])
            pooled.append(np.maximum(z[best[w], np.arange(FILTERS)], 0))
        p = np.concatenate(pooled, 1)
        err = (1 / (1 + np.exp(-np.clip(p @ self.out + self.base, -30, 30))) - y) / len(y)

        def move(name, value, grad):
            past[name] = past.get(name, 1e-6) + grad * grad
            return value - rate * grad / np.sqrt(past[name])

        back = err[:, None] * self.out * (p > 0)
        out = move("out", self.out, p.T @ err + 1e-4 * self.out)
        self.base = np.float32(move("base", self.base, err.sum()))
        words = np.full(len(x), -1)
        words[np.arange(len(ids)) + max(SPANS) * np.repeat(np.arange(len(at) - 1), np.diff(at))] = np.arange(len(ids))
        for j, w in enumerate(SPANS):
            d = back[:, j * FILTERS : (j + 1) * FILTERS].astype(np.float32)
            grad = np.zeros_like(self.filters[w])
            for k in range(w):
                seen = x[best[w] + k]  # rows, filters, width
                grad[k] = np.einsum("rf,rfd->df", d, seen)
                to = words[best[w] + k]
                use = to >= 0
                g = (d[:, :, None] * self.filters[w][k].T[None])[use]
                for c in range(ids.shape[1]):
                    np.add.at(self.vectors, ids[to[use], c], -0.3 * rate * g)
            self.bias[w] = move(("bias", w), self.bias[w], d.sum(0))
            self.filters[w] = move(("filter", w), self.filters[w], grad + 1e-4 * self.filters[w])
        self.out = out

    def score(self, ids: np.ndarray, whole: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lang = languages(whole, at)
        z = self.slope * (self.logits(ids, at).astype(float) - self.cut[lang]) + np.log(PREDICTED_FROM / (1 - PREDICTED_FROM))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), lang


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between scores that gives the fewest errors; before that, the widest gap."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.r_[0, np.cumsum(y)] + np.r_[(1 - y)[::-1].cumsum()[::-1], 0]  # predicted are those from i on
    lo, hi = np.r_[z[0] - 2, z], np.r_[z, z[-1] + 2]
    i = max(range(len(errors)), key=lambda i: (-errors[i], hi[i] - lo[i]))
    return float((lo[i] + hi[i]) / 2)


def fit(texts: list[str], labels: np.ndarray) -> Net:
    """Fit on a sample in a random order: half sets log odds, a third of the rest the cuts, the others train.

    A part without both labels is replaced by the whole sample; without both labels in that, every text gets one score.
    """
    net = Net()
    n = len(texts)
    if not n or labels.min() == labels.max():
        net.base = np.float32(-3 if not n or labels.max() == 0 else 3)
        net.out[:] = 0
        return net
    part = np.arange(n) % 6
    base, train, last = (use if len(set(labels[use])) == 2 else np.full(n, True) for use in (part < 3, (part == 3) | (part == 4), part == 5))
    counts = np.zeros((2, (1 << BITS) + 1))
    found, lang = [], []
    for lo in range(0, n, 100):  # a few texts at a time, as arrays over bytes are large
        ids, whole, at = word_ids(pa.array(texts[lo : lo + 100]))
        lang.append(languages(whole, at))
        for i in range(len(at) - 1):
            own = ids[at[i] : at[i + 1]]
            found.append(own)
            if base[lo + i]:
                counts[labels[lo + i], np.unique(own)] += 1

    def pick(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        take = [found[i] for i in rows]
        return np.concatenate(take), np.r_[0, np.cumsum([len(x) for x in take])]

    lang = np.concatenate(lang)
    total = counts.sum(0)
    clean, bad = max(1, (labels[base] == 0).sum()), max(1, (labels[base] == 1).sum())
    odds = np.log((counts[1] + 0.1) / (bad + 0.2)) - np.log((counts[0] + 0.1) / (clean + 0.2))
    net.vectors[:, 0] = np.where(total >= 2, np.clip(odds, -4, 6) * total / (total + 2), 0) * 0.25
    net.vectors[-1] = 0
    r = np.random.default_rng(11)
    past: dict = {}
    train = np.flatnonzero(train)
    epochs = -(-STEPS * 64 // max(1, len(train)))
    for epoch in range(epochs):
        order = r.permutation(train)
        for lo in range(0, len(order), 64):
            rows = order[lo : lo + 64]
            net.step(*pick(rows), labels[rows], 0.1 / (1 + 2 * epoch / epochs), past)
    last = np.flatnonzero(last)
    net_z = np.concatenate([net.logits(*pick(last[i : i + 200])) for i in range(0, len(last), 200)]).astype(float)
    lang = lang[last]
    whole_cut = best_cut(net_z, labels[last])
    for j in range(len(LANGUAGES)):
        own = lang == j
        enough = labels[last][own].sum() >= 5 and (labels[last][own] == 0).sum() >= 5
        net.cut[j] = best_cut(net_z[own], labels[last][own]) if enough else whole_cut
    return net


def held_out(doc_id):
    """Rows that labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> Net:
    """Fit on at most ``sample`` labelled documents that are not held out, by order of a hash of their ids.

    Null labels and texts are left out. A doc_id with several labels takes the largest one, with several texts the
    least one. In that order a text that would make the sample exceed ``most_chars`` is passed over. Without
    labels, or with one kind only, every text gets one score.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    texts = keep(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")
    sizes = texts.select("doc_id", F.length("text").alias("size")).toPandas()
    sizes = sizes.iloc[np.argsort(tb.mix(sizes.doc_id.to_numpy().astype(np.int64).view(np.uint64)), kind="stable")]
    ids, room = [], most_chars
    for i, n in zip(sizes.doc_id.tolist(), sizes["size"].tolist()):
        if n <= room:
            ids.append(i)
            room -= n
    rows = texts.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id").toPandas().set_index("doc_id").loc[ids]
    discard(texts)
    return fit(rows.text.tolist(), rows.label.to_numpy().astype(np.int64))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """Score every whole text; null and empty ones too. One row for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                scores, lang = net.score(*word_ids(b.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(scores), pa.array((scores >= PREDICTED_FROM).astype(np.int32)), pa.array([LANGUAGES[i] for i in lang])],
                    names=["doc_id", "held_out", "score", "predicted", "guessed_language"],
                )

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, SCORED)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic, each judged by its own text, also where a doc_id repeats. A null doc_id stays."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    text, doc_id = docs.columns.index("text"), docs.columns.index("doc_id")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.blocks(batch, "text"):
                scores, _ = sent.value.score(*word_ids(b.column(text)))
                yield b.filter(pa.array((scores < PREDICTED_FROM) | b.column(doc_id).is_null().to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(run, docs.schema)
