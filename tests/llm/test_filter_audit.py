"""Filters in all orders against applying them one after another."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import filter_audit as fa

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_lists_are_merged_as_sets():
    r = np.random.default_rng(1)
    for n, m in ((0, 0), (0, 9), (1, 1), (5000, 3), (700, 900), (64, 65), (4000, 4000)):
        a, b = (np.sort(r.choice(20_000, k, replace=False)) for k in (n, m))
        assert (fa.gallop(a, b) == np.searchsorted(a, b)).all()
        assert fa.union(a, b).tolist() == np.union1d(a, b).tolist()
        assert fa.size_of_common(a, b) == len(np.intersect1d(a, b)) and b[~fa.held(a, b)].tolist() == np.setdiff1d(b, a).tolist()


def failing(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and least[text] < i]
        yield i, source or "", {"ABCDE"[k] for k in range(5) if bad[k]}


def plain(rows, good, toxic):
    docs, out, total = list(failing(rows)), {}, {}
    for part in {x[1] for x in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in docs if x[1] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                fails = [x for x in docs if x[1] == part and f in x[2]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(x[2] == {f} for x in fails), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_filters_in_turn(spark, monkeypatch):
    monkeypatch.setattr(fa, "RANGE_ROWS", 40)
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "Up", "CAPS", "a#b"]
    rows = [(i, " ".join(r.choice(words[: r.choice([20, 60, 60, 65])]) for _ in range(r.choice([20, 49, 50, 51, 80]))) + r.choice(["", "", " 5%", "\x0b", " x"]), r.choice(["s", "s", "t", None])) for i in range(200)]
    rows += [(300 + i, rows[r.randrange(60)][1], r.choice("st")) for i in range(60)]
    rows += [(900, None, "n"), (901, "", "n"), (902, " \n", "n"), (None, rows[0][1], "s"), (None, None, None), rows[7], rows[7], (7, "another text", "t"), (903, "z" * 300_000, "s"), (904, "A b " * 70_000, "s")]
    marks = [(i, r.choice([0, 1, None]), r.choice([0, 0, 1])) for i in range(0, 330, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("part", "fails", "digest", "first", "good", "seen", "f"):
        docs = docs.withColumn(c, F.lit("own"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = fa.audit(docs, labels).collect()
    want = plain(rows, {i for i, q, _ in marks if q == 1 and i is not None}, {i for i, _, x in marks if x == 1 and i is not None})
    assert len(got) == len(want) and {(x.part, x.filter_order, x.step): tuple(x[c] for c in COLUMNS) for x in got} == want
    assert fa.audit(docs.limit(0), labels).count() == 0
    assert all(x.good_lost == x.toxic_lost == 0 for x in fa.audit(docs, labels.limit(0)).collect())
