"""Nearest vectors by blocks, the stored index, diversity, the search export and the guard, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import exports, image_index, nearness, plugs, segment, vectors
from lodestrata.operators import postprocess as pp

VECTORS = "vec_id long, embedding array<float>, label int"


def some(n, seed=1, dims=8, clusters=6):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (clusters, dims))[r.integers(0, clusters, n)] + r.normal(0, 0.4, (n, dims))
    rows = [(i, v.astype(np.float32).tolist(), int(i % 3 != 0)) for i, v in enumerate(x)]
    return rows + [(n, None, 0), (n + 1, [0.0] * dims, 0), (n + 2, rows[0][1], 1)]


def plain(rows, asked, k, same=False, threshold=None):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    ok = [r for r in rows if r[1] and any(r[1])]
    out = {}
    for q in asked:
        if q[1] and any(q[1]):
            s = sorted((-round(float(unit(q[1]) @ unit(r[1])), 6), r[0]) for r in ok if r[0] != q[0] and (not same or r[2] == q[2]))
            out[q[0]] = [(i, -x) for x, i in s[:k] if threshold is None or -x >= threshold]
    return {q: v for q, v in out.items() if v}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("same", [False, True])
def test_nearest_equals_all_pairs(spark, monkeypatch, same):
    monkeypatch.setattr(nearness, "FEW", 20)
    rows = some(300)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    q = df.where("vec_id % 7 = 0 or vec_id >= 300")
    asked = [r for r in rows if r[0] % 7 == 0 or r[0] >= 300]
    assert found(vectors.nearest(df, q, 5, "label" if same else None)) == plain(rows, asked, 5, same)
    assert found(vectors.nearest(df, q, 4, threshold=0.9)) == plain(rows, asked, 4, threshold=0.9)
    assert vectors.nearest(df.limit(0), q, 3).count() == vectors.nearest(df, q.limit(0), 3).count() == 0


def test_the_index_reads_probed_cells_and_finds_most(spark, tmp_path):
    rows = some(1500, 3, clusters=20)
    df = spark.createDataFrame(rows, VECTORS)
    index = image_index.build(df, str(tmp_path / "index"), cells=24, sample=400)
    assert spark.read.parquet(str(tmp_path / "index" / "rows")).count() == 1501 == spark.read.parquet(str(tmp_path / "index" / "cells")).agg(F.sum("n")).first()[0]
    q = df.where("vec_id % 50 = 0")
    want = plain(rows, [r for r in rows if r[0] % 50 == 0], 10)
    assert found(image_index.search(index, q, 10, exact=True)) == want
    again = image_index.load(spark, str(tmp_path / "index"))
    got = found(image_index.search(again, q, 10))
    assert sum(len(set(v) & set(got[k])) for k, v in want.items()) >= 0.9 * sum(map(len, want.values()))  # recall
    one = image_index.search(again, q.where("vec_id = 50"), 10, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan
    hits = image_index.payloads(image_index.search(index, q, 3), df.select("vec_id", "label"), 0.9)
    assert set(hits.columns) >= {"label", "score"} and hits.where("score < 0.9").count() == 0
    plug = plugs.Plug(lambda client, rows_: [rows[int(r["text"])][1] for r in rows_], "array<double>", retries=0)
    hits, failed = image_index.search_texts(index, spark.createDataFrame([(-1, "50"), (-2, "none")], "vec_id long, text string"), plug, 3, exact=True)
    assert found(hits)[-1][0] == (50, 1.0) and [r.vec_id for r in failed.collect()] == [-2]
    empty = image_index.build(df.limit(0), str(tmp_path / "empty"))
    assert image_index.search(empty, q, 3).count() == 0


def test_diversity_equals_one_pass(spark):
    r = random.Random(5)
    rows = [(i, r.choice([None, "a", "b", "c", "d", "e", "f"]), f"b{r.randrange(12)}") for i in range(120)]
    for most in (1, 2, 3):
        seen, counts, want = set(), {}, []
        for i, identity, bucket in rows:
            if identity in seen or counts.get(bucket, 0) >= most:
                continue
            if identity:
                seen.add(identity)
            counts[bucket] = counts.get(bucket, 0) + 1
            want.append((i, counts[bucket]))
        got = pp.diverse(spark.createDataFrame(rows, "i int, identity string, bucket string").repartition(3), "identity", "bucket", most, [F.col("i")])
        assert sorted((x.i, x.bucket_rank) for x in got.collect()) == want


def test_search_export_has_all_columns_in_order(spark):
    ref = F.struct(F.lit("Net").alias("network"), F.lit("posting").alias("type"), F.lit("S1").alias("speaker"), F.lit("p").alias("posting_id"))
    df = spark.createDataFrame([("n1", "f", "whole text", "image"), ("n2", "g", "x", " ")], "node_id string, filename string, text string, kind string").withColumn("reference", ref)
    got = exports.search(df, ["n2"])
    assert got.columns == list(exports.SEARCH) and len(got.columns) == 29
    a, b = got.orderBy("chunk_id").collect()
    assert (a.marked, a.kind, a.source, a.chunk_text, a.network, a.type, a.speaker, a.posting_id, a.uuid) == ("false", "image", "f", "whole text", "Net", "posting", "S1", "p", "")
    assert (b.marked, b.kind) == ("true", "text")


def test_an_oversize_row_stops_the_job_before_anything_is_written(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([35, 70, 7, 350])] + [(9, None)], "i int, text string").repartition(3)
    rows, seen = segment.guarded(df, "text", 100)
    rows.write.parquet(str(tmp_path / "good"))
    assert seen.get == {"rows": 5, "tokens": 10 + 20 + 2 + 100, "largest": 100} and spark.read.parquet(str(tmp_path / "good")).columns == ["i", "text"]
    rows, _ = segment.guarded(df, "text", 99)
    with pytest.raises(Exception, match="over the budget of 99"):
        rows.write.parquet(str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.parquet"))
