"""Term shares of sources against plain loops, and the tree of rows against its definition."""

import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"


def plain(rows, least, top):
    tf, df, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        tf.update((lang, source, w) for w in words)
        df.update((lang, w) for w in set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [w for (x, w), n in df.items() if x == lang and n >= least]
        v = len(kept)
        count = {s: {w: tf[lang, s, w] for w in kept} for s in sources}
        count[None] = {w: sum(count[s][w] for s in sources) for w in kept}
        p = {s: {w: 1 + 10**9 * (c + 5) // (sum(n.values()) + 5 * v) for w, c in n.items()} for s, n in count.items()}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((p[None][w] - p[s][w], w.encode(), w) for w in kept if count[s][w] and p[s][w] > p[None][w])[:top]
            out |= {(lang, s, part, x, -value, i) for part, ranked in (("pair", pairs), ("term", terms)) for i, (value, _, x) in enumerate(ranked, 1)}
    return out


def test_tree_corrections_are_sums_over_rows():
    r = random.Random(4)
    for n in (0, 1, 40, 300):
        rows = collections.Counter(tuple((s, r.randrange(60, 64), 50 + s) for s in range(8) if r.random() < 0.6) for _ in range(n))
        rows = sorted((x, k) for x, k in rows.items() if x)
        want = collections.Counter()
        for path, m in rows:
            for i, (a, pa, za) in enumerate(path):
                for b, pb, zb in path[i + 1 :]:
                    want[a, b] += m * (abs(pa - pb) - abs(pa - zb) - abs(za - pb) + abs(za - zb))
        flat = np.array([x for path, _ in rows for x in path], np.int64).reshape(-1, 3)
        offs = np.r_[0, np.cumsum([len(path) for path, _ in rows])].astype(int)
        a, b, c = divergence.tree_corrections(*flat.T, offs, np.array([k for _, k in rows], np.int64))
        assert {(x, y): v for x, y, v in zip(a.tolist(), b.tolist(), c.tolist())} == dict(want)


def test_audit_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH", 200)
    r = random.Random(8)
    words = [f"{a}{b}" for a in ("ab", "Éa", "c", "日", "zz") for b in ("x", "Yy", "é", "")]
    rows = []
    for i in range(300):
        source = r.choice(["s1", "s1", "s2", "s3", "é", None])
        text = " ".join(r.choice(words[: 6 + 3 * (source == "s2")] if r.random() < 0.8 else words) + r.choice([",", " 9", "_", "\x7f", "\n", " "]) for _ in range(r.randrange(25)))
        rows.append((i, text, r.choice(["en", "en", "de", None]), source))
    rows += [(900, None, "en", "only null"), (901, "", "xx", "a"), (902, "rare", "xx", "b"), (903, "ab " * 50_000, "en", "s1"), rows[3], rows[3], (None, "ab c", "en", "s2")]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("n", "p", "s", "rank", "item", "term"):
        docs = docs.withColumn(c, F.lit("own"))
    for least in (5, 60, 10_000):
        got = [tuple(x) for x in divergence.audit(docs, least, 4).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, least, 4)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    big = spark.range(1).select(divergence.share(F.lit(3 * 10**12), F.lit(7 * 10**13), F.lit(10**6)).alias("p"), divergence.share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert big.p == 1 + 10**9 * (3 * 10**12 + 5) // (7 * 10**13 + 5 * 10**6) and big.none is None
