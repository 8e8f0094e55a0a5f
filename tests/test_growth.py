"""Steps whose time and memory go with the input."""

import math
import re
import time
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import nearness, rollups
from lodestrata.operators import postprocess as pp
from lodestrata.operators import vectors as ve
from lodestrata.plans import catalog


def test_passages_are_found_in_a_long_text_in_time_that_goes_with_its_length(spark):
    words = [f"w{i}" for i in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w5 w6\nw7 w8 w9 w10 w11"), (3, None), (4, "w9 w8"), (5, "")], "doc_id long, text string")
    passages = spark.createDataFrame([(7, "w50000 w50001 w50002 w50003 w50004 w50005 w50006"), (8, "w6 w7 w8 w9 w10 w11"), (9, "w9 w8")], "query_id long, passage string")
    began = time.time()
    assert sorted(map(tuple, rollups.containing(docs, passages).collect())) == [(7, 1), (8, 1), (9, 4)]
    assert time.time() - began < 40


@pytest.mark.parametrize("cells", [4_000_000, 7])
def test_best_texts_of_each_query_by_blocks(spark, monkeypatch, cells):
    monkeypatch.setattr(ve, "ROWS", 5), monkeypatch.setattr(ve, "QUERIES", 2), monkeypatch.setattr(ve, "CELLS", cells)
    texts = [(i, " ".join(f"t{(i * k) % 7}" for k in range(1 + i % 5))) for i in range(40)] + [(40, None), (41, "")]
    queries = [(1, "t0 t1 t1"), (2, "T3 none"), (3, "zz"), (4, "t2 t4 t6 t6"), (5, None)]
    got = ve.sparse_top(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"), 3, "doc_id", "item_id")
    weights = lambda s: {t: 1 + math.log(n) for t, n in Counter(x for x in re.split(r"\W+", (s or "").lower()) if len(x) > 1).items()}
    want = []
    for q, a in queries:
        scores = [(-round(sum(w * weights(b)[t] for t, w in weights(a).items() if t in weights(b)), 6), d) for d, b in texts if weights(a).keys() & weights(b).keys()]
        want += [(q, d, -s, r) for r, (s, d) in enumerate(sorted(scores)[:3], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 6


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_a_task_has_one_block_and_makes_its_words_itself(spark, monkeypatch, broadcast):
    texts = spark.createDataFrame([(i, " ".join(f"t{(i * k) % 11}" for k in range(i))) for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "t0 t1 t1"), (2, "t3 none"), (3, "zz")], "item_id long, text string")
    want = sorted(map(tuple, ve.sparse_top(texts, queries, 4, "doc_id", "item_id").collect()))
    seen, made = [], ve.counted
    monkeypatch.setattr(ve, "counted", lambda each, *by: (seen.append(each) if "b" in by else None) or made(each, *by))
    monkeypatch.setattr(ve, "ROWS", 1000), monkeypatch.setattr(ve, "BYTES", 300), monkeypatch.setattr(ve, "COPIES", 7), monkeypatch.setattr(nearness, "GROUPS", broadcast)
    assert sorted(map(tuple, ve.sparse_top(texts, queries, 4, "doc_id", "item_id").collect())) == want and len(want) == 8
    at = [tuple(r) for r in seen[0].select("b", F.spark_partition_id()).distinct().collect()]
    assert len(at) > 8 and all(b == p for b, p in at)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.index("split(") < plan.index("Exchange")


def test_parents_are_packed_without_a_python_call_for_each_query(spark):
    rows = [(q, p, f"c{p}", None if (q + p) % 5 == 0 else f"p{(q * p) % 4}", None if (q * p) % 4 == 3 else 10 + 7 * ((q * p) % 4)) for q in range(30) for p in range(q % 9)]
    want = []
    for q in range(30):
        left, seen = 30, set()
        for _, p, node, parent, n in (r for r in rows if r[0] == q):
            if parent is None:
                want.append((q, p, node, "hit"))
            elif parent not in seen:
                seen.add(parent)
                whole = left > 0 and n is not None and n <= left
                left -= n if whole else 0
                want.append((q, p, parent if whole else node, "parent" if whole else "child"))
    hits = spark.createDataFrame(rows, "query_id long, position int, node_id string, parent_id string, parent_tokens long").withColumn("child_tokens", F.lit(1))
    got = pp.pack_parents(hits, 30)
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[3] for w in want} == {"hit", "parent", "child"}
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["query_expansion", "relation_endpoints"])
def test_mentions_are_not_found_again_for_each_later_step(spark, name):
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not any("documents.parquet" in f for f in got.inputFiles())


def test_diversity_equals_its_sql_where_a_full_hour_turns_posts_away(spark, tmp_path):
    at = [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=17 * (i // 3)) for i in range(400)]
    events = pd.DataFrame({"event_id": range(400), "ts": pd.Series(at).astype("datetime64[us]"), "user_id": [i % 3 for i in range(400)], "event_type": "view", "value": [float(i * i % 23) for i in range(400)], "props": "{}"})
    events.to_parquet(tmp_path / "events.parquet")
    seen, full, want = set(), Counter(), []
    for r in events.itertuples():
        bucket = f"{r.user_id}::{r.ts:%Y-%m-%dT%H}"
        if (r.user_id, r.value) not in seen and full[bucket] < 2:
            seen.add((r.user_id, r.value))
            full[bucket] += 1
            want.append((r.event_id, bucket, full[bucket]))
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert sorted(c.sql(catalog.ORACLES["social_diversity"]).fetchall()) == want
    assert sorted(map(tuple, catalog.QUERIES["social_diversity"](spark, str(tmp_path)).collect())) == want


def test_rows_that_meet_are_copied_a_few_times_only(spark, monkeypatch):
    monkeypatch.setattr(nearness, "FEW", 16)
    rows = spark.range(2500).select(F.when(F.col("id") < 2000, "a").otherwise("b").alias("g"), F.col("id").alias("pos"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    count = lambda p, q, s: {"pos": p, "n": (s == s).sum(axis=1)}
    got = nearness.meet(rows, rows, count, "pos long, n long").groupBy("pos").agg(F.count("n").alias("copies"), F.sum("n").alias("met")).collect()
    assert {(r.pos < 2000, r.met) for r in got} == {(True, 2000), (False, 500)} and len(got) == 2500
    assert max(r.copies for r in got) <= 8


def test_a_graph_finds_its_mentions_once(spark, monkeypatch):
    read, made = [], catalog.en.co_occurrence
    monkeypatch.setattr(catalog.en, "co_occurrence", lambda found, *how: read.extend(found.inputFiles()) or made(found, *how))
    catalog.graph(spark, "/root/testdata/sf0.001")
    assert read and not any("documents.parquet" in f for f in read)
