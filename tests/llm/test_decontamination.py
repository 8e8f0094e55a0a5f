"""Hit words and items against looking for every window in every document."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import decontamination as dc


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for item, t in items:
            x = words_of(t)
            for win in {tuple(x[i : i + size]) for i in range(max(1, len(x) - size + 1))} if x else ():
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p : p + len(win)]) == win:
                        hit.update(range(p, p + len(win)))
                        ids.add(item)
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit), ids))
    return sorted(out, key=str)


@pytest.mark.parametrize("lookup", [2_000_000, 40])
def test_report_equals_looking_for_every_window(spark, monkeypatch, lookup):
    monkeypatch.setattr(dc, "LOOKUP", lookup)
    r = random.Random(6)
    vocabulary = ["the", "a", "of"] * 6 + [f"w{i}" for i in range(12)] + ["É", "日本", "x9"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([3, 9, 10, 11, 14, 30]))) for i in range(40)]
    items += [(100, None), (101, " . "), (102, "W1"), (103, "w2 w3"), (None, text(12)), (104, items[3][1]), (3, text(12)), (105, "the " * 25), (11, items[5][1].upper())]
    docs = []
    for i in range(80):
        parts = [text(r.randrange(12)) for _ in range(4)]
        for _ in range(r.randrange(3)):
            x = (r.choice(items)[1] or "").split()
            lo = r.randrange(len(x) + 1)
            parts.insert(r.randrange(4), " - ".join(x[lo : lo + r.choice([8, 10, 15, 30])]))
        docs.append((i, ". ".join(parts)))
    docs += [(900, None), (901, ""), (902, "..."), (903, "the " * 3000), (904, text(30_000)), (None, items[2][1] + " of"), docs[4], docs[4], (4, items[1][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for c in ("h", "n", "pos", "words", "item", "version", "items", "offset"):
        table = table.withColumn(c, F.lit("own"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("own"))
    got = [(x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated, list(x["items"])) for x in dc.report(table, bench).collect()]
    assert sorted(got, key=str) == plain(docs, items)
    assert sum(x[5] for x in got) > 40 and not all(x[5] for x in got)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert dc.report(docs.limit(0), bench).count() == 0
    for some in (bench.limit(0), bench.withColumn("text", F.lit("three")), bench.withColumn("text", F.lit(None).cast("string"))):
        assert [(x.doc_id, x.n_words, x.n_hit, x.items_sha256) for x in dc.report(docs, some).orderBy("doc_id").collect()] == [(1, 2, 0, hashlib.sha256(b"").hexdigest()), (2, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    h = dc.word_hashes(pa.array(["a", "bb", "a", "ccc", "a", "bb"]))
    assert h[0] == h[2] == h[4] and h[1] == h[5] != h[3]
    s = dc.shingle_hashes(h, 2)
    assert s[0] == s[4] and len(dc.shingle_hashes(h[:1], 2)) == 0
    assert dc.word_hashes(pa.array(["zz", "a", "bb"])[1:]).tolist() == h[:2].tolist()
