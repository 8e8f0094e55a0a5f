"""Files of an ingest as a stream of events, against a loop; keyed tables that take a batch twice."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import state
from lodestrata.sources.keyed import KeyedTable
from lodestrata.streaming import files

EVENTS = "collection string, file_hash string, status string, at timestamp, error string"


def put(spark, path, rows, at):
    df = spark.createDataFrame([(c, h, s, float(i), e) for c, h, s, i, e in rows], "collection string, file_hash string, status string, s double, error string")
    df.select("collection", "file_hash", "status", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("at"), "error").coalesce(1).write.parquet(f"{path}/{at:04d}", mode="overwrite")


def run(spark, tmp_path, **how):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    table = files.manifest_table(str(tmp_path / "manifest"), 4)
    q = files.follow(stream, table, str(tmp_path / "check"), **how)
    q.awaitTermination()
    return table.read(spark), q


def test_states_follow_the_events_and_time_limits(spark, tmp_path):
    batches = [
        [("c", "a", "started", 10, None), ("c", "b", "started", 11, None), ("c", "late", "started", 12, None), ("", "x", "started", 12, None), ("c", None, "started", 12, None)],
        [("c", "a", "completed", 20, None), ("c", "b", "failed", 21, "E" * 2000), ("d", "a", "started", 22, None), ("c", "odd", "unknown", 22, None)],
        [("c", "a", "started", 30, None), ("c", "z", "failed", 31, None), ("c", "r", "failed", 31, "once"), ("c", "r", "started", 33, None), ("d", "a", "completed", 35, None)],
    ]
    for i, rows in enumerate(batches):
        put(spark, tmp_path / "in", rows, i)
    got, _ = run(spark, tmp_path, late="5 seconds", limit=100, memory=500)
    rows = {(r.collection, r.file_hash): r for r in got.collect()}
    assert {k: r.status for k, r in rows.items()} == {("c", "a"): "completed", ("c", "b"): "failed", ("c", "late"): "in_progress", ("d", "a"): "completed", ("c", "z"): "failed", ("c", "r"): "in_progress"}
    assert rows["c", "b"].error == "E" * 511 + "…" and rows["c", "z"].error is None and rows["c", "r"].error is None
    assert rows["c", "a"].started_at.timestamp() % 60 == 10 and rows["c", "a"].updated_at.timestamp() % 60 == 30
    assert {r.file_hash for r in files.pending(got, "c").collect()} == {"late", "r"} and [r.file_hash for r in files.completed(got, "d").collect()] == ["a"]
    # time goes on: what was started and never ended fails, with the time of its limit
    put(spark, tmp_path / "in", [("c", "new", "started", 300, None)], 3)
    put(spark, tmp_path / "in", [("c", "new", "completed", 301, None)], 4)
    got, _ = run(spark, tmp_path, late="5 seconds", limit=100, memory=500)
    assert {r.file_hash: r.error for r in files.failed(got, "c").collect() if r.file_hash in ("late", "r")} == {"late": "no end within 100 seconds", "r": "no end within 100 seconds"}
    assert files.pending(got, "c").count() == 0


def test_state_is_bounded_when_files_are_replayed(spark, tmp_path):
    for i in range(8):
        put(spark, tmp_path / "in", [("c", f"{i}-{k}", s, 100 * i + j, None) for k in range(20) for j, s in enumerate(("started", "completed"))], i)
    got, q = run(spark, tmp_path, late="10 seconds", limit=50, memory=150)
    assert got.count() == 160
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    put(spark, tmp_path / "in", [("c", f"0-{k}", "started", 3, None) for k in range(20)], 50)  # far too late
    again, q = run(spark, tmp_path, late="10 seconds", limit=50, memory=150)
    assert max(held) < 8 * 20 * 3 and held[-1] <= max(held) and {r.status for r in again.collect()} == {"completed"} and again.count() == 160


def test_stream_and_batch_manifests_agree(spark):
    r = random.Random(3)
    events = [("c", f"h{r.randrange(25)}", r.choice(["started", "completed", "failed"]), i, r.choice([None, "bad"])) for i in range(200)]
    held = {}
    for c, h, s, at, e in events:
        held[h] = files.after(held.get(h), s, at, e)
    df = spark.createDataFrame([(c, h, s, float(i), e) for c, h, s, i, e in events] + [("", "h1", "failed", 999.0, None)], "collection string, file_hash string, status string, s double, error string")
    got = state.merge_manifest(df.withColumn("at", F.timestamp_seconds("s")))
    assert {x.file_hash: (x.status, x.error) for x in got.collect()} == {h: (v[0], v[3]) for h, v in held.items()}


@pytest.mark.parametrize("twice", [False, True])
def test_keyed_tables_hold_the_latest_row(spark, tmp_path, twice):
    table = KeyedTable(str(tmp_path / "t"), "k string, at long, v string", ("k",), ("at",), 8)
    assert table.read(spark).count() == 0 and table.lookup(spark.createDataFrame([("a",)], "k string")).count() == 0
    want, r = {}, random.Random(1)
    for b in range(4):
        rows = [(f"k{r.randrange(12)}", r.randrange(30), f"v{b}{i}") for i in range(15)] + [(None, 1, "x")]
        for _ in range(1 + twice):
            table.upsert(spark.createDataFrame(rows, table.schema).repartition(3))
        for k, at, v in rows:
            if k is not None:
                want[k] = max(want.get(k, (-1, "")), (at, v))
    assert {x.k: (x.at, x.v) for x in table.read(spark).collect()} == want
    one = table.lookup(spark.createDataFrame([("k3",), ("none",)], "k string"))
    assert [(x.k, x.at, x.v) for x in one.collect()] == [("k3", *want["k3"])]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    table.upsert(spark.createDataFrame([("k3", 99, "new")], table.schema))
    kept = [p for p in before if p.exists() and p.stat().st_mtime_ns == before[p]]
    assert {p.parent.name for p in before} - {p.parent.name for p in kept} == {"bucket=" + str(spark.createDataFrame([("k3",)], "k string").select(table.bucket()).first()[0])}
