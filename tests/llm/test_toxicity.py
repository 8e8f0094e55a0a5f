"""The convolutional classifier against plain loops, and on texts without words and few labels."""

import copy

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import toxicity
from lodestrata.llm.toxicity import FILTERS, SPANS, WIDTH

DOCS = "doc_id long, text string"
TEXTS = ["one two three four", "", "1 2 3", "five", None, "six six seven six", ""]


def plain(net, ids):
    """Pooled answers and the windows that gave them, word by word."""
    v = [sum(net.vectors[i].astype(float) for i in row) for row in ids]
    zero = np.zeros(WIDTH)
    pooled, best = [], []
    for w in SPANS:
        answers = [[float(net.bias[w][f]) + sum(float((v[p + k] if p + k < len(v) else zero) @ net.filters[w][k][:, f]) for k in range(w)) for f in range(FILTERS)] for p in range(max(len(v), 1))]
        at = [max(range(len(answers)), key=lambda p: (answers[p][f], -p)) for f in range(FILTERS)]
        best.append(at)
        pooled.append([max(answers[at[f]][f], 0.0) for f in range(FILTERS)])
    return pooled, best, v


def test_forward_pass_equals_plain_loops_whatever_the_neighbours():
    net = toxicity.Net()
    ids, whole, at = toxicity.word_ids(pa.array(TEXTS))
    got = net.logits(ids, at)
    want = [float(np.concatenate(plain(net, ids[at[i] : at[i + 1]])[0]) @ net.out + net.base) for i in range(len(TEXTS))]
    assert np.allclose(got, want, atol=1e-5)
    for i, t in enumerate(TEXTS):  # alone as among others
        assert np.isclose(net.logits(*(lambda x: (x[0], x[2]))(toxicity.word_ids(pa.array([t], pa.string()))))[0], got[i], atol=1e-6)
    for texts in ([""], ["a b", ""], ["", "a b"], [None], []):
        scores, lang = net.score(*toxicity.word_ids(pa.array(texts, pa.string())))
        assert len(scores) == len(texts) and np.isfinite(scores).all()


def test_a_training_step_equals_plain_loops():
    net = toxicity.Net()
    ids, _, at = toxicity.word_ids(pa.array(TEXTS))
    y = np.array([1, 0, 1, 0, 0, 1, 1])
    old = copy.deepcopy(net)
    net.step(ids, at, y, 0.1, {})
    out, base = np.zeros(len(old.out)), 0.0
    filters = {w: np.zeros((w, WIDTH, FILTERS)) for w in SPANS}
    bias = {w: np.zeros(FILTERS) for w in SPANS}
    moved = {}
    for i in range(len(TEXTS)):
        own = ids[at[i] : at[i + 1]]
        pooled, best, v = plain(old, own)
        flat = np.concatenate(pooled)
        err = (1 / (1 + np.exp(-(flat @ old.out + old.base))) - y[i]) / len(y)
        out += err * flat
        base += err
        for j, w in enumerate(SPANS):
            for f in range(FILTERS):
                if pooled[j][f] <= 0:
                    continue
                back = err * old.out[j * FILTERS + f]
                bias[w][f] += back
                for k in range(w):
                    p = best[j][f] + k
                    if p < len(v):
                        filters[w][k][:, f] += back * v[p]
                        for b in own[p]:
                            moved[b] = moved.get(b, 0) - 0.3 * 0.1 * back * old.filters[w][k][:, f]
    step = lambda g: 0.1 * g / np.sqrt(1e-6 + g * g)  # noqa: E731  the first of Adagrad
    assert np.allclose(net.out, old.out - step(out + 1e-4 * old.out), atol=1e-4)
    assert np.isclose(net.base, old.base - step(base), atol=1e-5)
    for w in SPANS:
        assert np.allclose(net.bias[w], old.bias[w] - step(bias[w]), atol=1e-3)
        assert np.allclose(net.filters[w], old.filters[w] - step(filters[w] + 1e-4 * old.filters[w]), atol=2e-3)
    for b, x in moved.items():
        assert np.allclose(net.vectors[b], old.vectors[b] + x, atol=1e-5)


@pytest.mark.parametrize("n", range(1, 9))
def test_few_labels(n):
    texts = [["bad words", "", "good ones here", "vile bad"][i % 4] for i in range(n)]
    labels = np.array([[1, 1, 0, 1][i % 4] for i in range(n)])
    net = toxicity.fit(texts, labels)
    scores, _ = net.score(*toxicity.word_ids(pa.array([*texts, "", "others"])))
    assert len(scores) == n + 2 and ((scores >= 0) & (scores <= 1)).all()
    if n >= 3:
        assert scores[0] > scores[2]


def test_labelled_texts_without_words():
    net = toxicity.fit([""] * 30, np.arange(30) % 2)
    assert np.isfinite(net.score(*toxicity.word_ids(pa.array(["", "a"])))[0]).all()


def test_tables_without_words_repeated_rows_and_long_texts(spark):
    void = spark.createDataFrame([(i, [None, "", "1 2"][i % 3]) for i in range(9)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    out = toxicity.score(void, toxicity.train(void, labels)).collect()
    assert len(out) == 9 and len({x.score for x in out}) == 1
    docs = spark.createDataFrame([(i, t) for i in range(60) for t in (["bad stuff", "nice stuff"][i % 2], "other")] + [(77, "w " * 3000)], DOCS)
    labels = spark.createDataFrame([(i, v) for i in [*range(60), 77] for v in ((1 - i % 2), 0)], "doc_id long, toxic int")  # the larger label counts
    a, b = (toxicity.train(d, x) for d, x in ((docs, labels), (docs.orderBy("text"), labels.orderBy("toxic"))))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.cut, b.cut)
    short = toxicity.train(docs, labels, most_chars=500)  # passes the long text over, not the rest
    long_only = toxicity.train(docs.where("doc_id <> 77"), labels, most_chars=500)
    assert np.array_equal(short.vectors, long_only.vectors)
