"""Texts built so that polynomial hashes modulo 2^64 collide, repeated rows of vectors, and keys that very many lines share."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import knn, lines, ngram_jaccard, textbytes

from .test_operators import edit_distance

TEXT = "doc_id long, text string"
MORSE = "".join("ab"[i.bit_count() & 1] for i in range(2048))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))


def test_sums_of_powers_collide_and_digests_do_not():
    both = np.frombuffer((MORSE + OTHER).encode(), np.uint8)
    at = np.array([0, 2048]), np.array([2048, 4096])
    assert len(set(textbytes.Spans(both)(*at).tolist())) == 1
    assert len({tuple(x) for x in textbytes.digests(both, *at).tolist()}) == 2
    hashes, _ = textbytes.words(both, np.array([0, 2048, 4096]))
    assert len(set(hashes.tolist())) == 2


def test_different_lines_with_equal_sums_stay(spark):
    docs = spark.createDataFrame([(1, MORSE), (2, OTHER), (3, MORSE)], TEXT)
    got = {x.doc_id: list(x.exact_removed) for x in lines.report(docs).collect()}
    assert got == {1: [], 2: [], 3: [0]}


def test_different_words_with_equal_sums_do_not_link(spark):
    docs = spark.createDataFrame([(1, MORSE), (2, OTHER), (3, MORSE), (4, " ".join([MORSE] * 9)), (5, " ".join([OTHER] * 9))], TEXT)
    assert {x.doc_id: x.component_id for x in ngram_jaccard.classes(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def brute(rows, asked, k):
    want = set()
    for q, v in {i: min(v for j, v in asked if j == i) for i, _ in asked}.items():
        found = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in rows if i != q)[:k]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)}
    return want


def test_nearest_rows_where_ids_repeat(spark):
    r = random.Random(2)
    vector = lambda scale=50: [r.randrange(-scale, scale) for _ in range(6)]
    rows = [(i, vector()) for i in range(600)]
    own = [(700, [200, 0, 0, 0, 0, r.randrange(5)]) for _ in range(31)]
    rows += own + [(800, vector(9)) for _ in range(4)] + [(801, [60] * 6)] * 12 + [(802, vector(9)) for _ in range(3)]
    asked = [own[0], own[5], *rows[:5], *rows[:2], (800, vector()), (999, vector())]
    schema = "vec_id long, v array<long>"
    got = knn.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), k=10, pivots=20).collect()
    assert len(got) == 10 * len({q for q, _ in asked}) and {tuple(x) for x in got} == brute(rows, asked, 10)


def test_scores_at_the_end_of_64_bits(spark):
    schema = "vec_id long, v array<long>"
    big = 3_000_000_000
    rows = spark.createDataFrame([(0, [big, 0]), (1, [big, 1]), (2, [-big, big]), (3, [0, 1])], schema)
    got = knn.top_k(rows, rows.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in got] == [(1, big * big), (3, 0), (2, -big * big)]
    with pytest.raises(Exception, match="64 bits"):
        spark.createDataFrame([([1e300],)], "e array<double>").select(knn.scaled(F.col("e"))).collect()


def test_lines_of_a_frequent_key_meet_in_their_own_tasks_too(spark):
    r = random.Random(5)
    base = "of every line this beginning, whoever wrote it, is the same: "
    texts = ["\n".join(base + f"{r.randrange(10**6):06d}" + r.choice(["", " and more", "."]) for _ in range(12)) for _ in range(25)]
    rows = list(enumerate(texts))
    got = lines.report(spark.createDataFrame(rows, TEXT).repartition(5))
    first = {}
    for d, text in rows:
        for k, x in enumerate(text.split("\n")):
            first.setdefault(x, (d, k))
    want = collections.Counter()
    names = sorted(first, key=first.get)
    for i, a in enumerate(names):
        for b in names[:i]:
            if abs(len(a) - len(b)) <= 2 and edit_distance(a[len(base) :], b[len(base) :]) <= 2:
                want[first[a][0]] += 1
    assert {x.doc_id: x.n_links for x in got.collect() if x.n_links} == want
    docs = lines.versions(spark.createDataFrame(rows, TEXT).repartition(5))
    bundles = lines.probes(docs, 4, 20).where("not met").select(F.expr("length(h1) / 8 as n"))
    assert bundles.agg(F.sum("n")).first()[0] < 300 * 9 * 3


def test_long_runs_met_keeps_a_run_long_and_of_two_lines():
    r = np.random.default_rng(0)
    for n in (0, 1, 30, 400):
        rows = np.unique(np.stack([r.integers(1, 5, n), r.integers(0, 60, n), r.integers(0, 8, n)], 1), axis=0)
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 2] & 1 ^ 1, rows[:, 0])) if n else []
        key, of, sig = rows[order].T if n else (np.zeros(0, int),) * 3
        stay, met = lines.long_runs_met(key, of, sig)
        for k in set(key.tolist()):
            run = key == k
            long = run.sum() > lines.SHORT_RUN and (sig[run] & 1).any() and len(set(of[run].tolist())) > 1
            assert met[run].all() == long == met[run].any()
            assert not long or (lines.SHORT_RUN < stay[run].sum() <= lines.SHORT_RUN + 2 and (sig[run & stay] & 1).any() and len(set(of[run & stay].tolist())) > 1)
            assert long or stay[run].all()
