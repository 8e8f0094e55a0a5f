"""The list entries of op9: every event on all hosts of its user's bucket, and the query beside its SQL."""

import hashlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

queries = pytest.importorskip("lodestrata.llm.queries")


def test_an_event_acts_on_all_hosts_of_its_bucket(spark, tmp_path):
    hosts = [f"h{i}.site{i % 40}.org" for i in range(600)]
    pages = pd.DataFrame({"page_id": [5 * i + 3 for i in range(len(hosts))], "url": [f"http://{h}/p" for h in hosts], "html": "x"})
    at = pd.date_range("2024-01-02", periods=40, freq="17h").astype("datetime64[us]")
    events = pd.DataFrame({"event_id": range(40), "ts": at, "user_id": [i * 3 for i in range(40)], "event_type": (["error", "purchase", "view", "signup"] * 10), "value": [i / 4 for i in range(40)], "props": "{}"})
    pages.to_parquet(tmp_path / "pages.parquet"), events.to_parquet(tmp_path / "events.parquet")
    bucket = lambda h: int(hashlib.md5(h.encode()).hexdigest()[:4], 16) % 97
    want = sorted((f"list{e % 3}", ".".join(h.split(".")[-2:]) if e % 5 == 0 else h, e / 4) for e, u in zip(events.event_id, events.user_id) for h in hosts if bucket(h) == u % 97)
    got = queries.list_entries(spark, str(tmp_path)).select("list_name", "key", "weight").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 200
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in ("pages", "events"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    names = ["page_id", "host", "n_lists", "lists", "allowed", "blocked", "decision"]
    rows = c.sql(f"select {', '.join(names)} from ({queries.OP9}) x").fetchall()
    assert sorted(rows) == sorted(map(tuple, queries.op9_url_filters(spark, str(tmp_path)).select(*names).collect()))
    assert sum(r[2] for r in rows) > 100


@pytest.mark.parametrize("ids", [range(12), range(1007, 1043, 3)])
def test_an_event_whose_bucket_has_no_host_acts_on_hosts_of_pages(spark, tmp_path, ids):
    hosts = [f"h{i % 5}.site{i % 2}.org" for i in range(11)]
    pages = pd.DataFrame({"page_id": list(ids), "url": [*(f"http://{h}/p" for h in hosts), None], "html": "x"})
    taken = {int(hashlib.md5(h.encode()).hexdigest()[:4], 16) % 97 for h in hosts}
    user = next(u for u in range(97) if u not in taken)
    at = pd.date_range("2024-01-01", periods=60, freq="13h").astype("datetime64[us]")
    events = pd.DataFrame({"event_id": range(60), "ts": at, "user_id": user, "event_type": (["error", "purchase", "signup"] * 20), "value": [i / 4 for i in range(60)], "props": "{}"})
    pages.to_parquet(tmp_path / "pages.parquet"), events.to_parquet(tmp_path / "events.parquet")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in ("pages", "events"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    names = ["page_id", "host", "n_lists", "lists", "allowed", "blocked", "decision"]
    rows = c.sql(f"select {', '.join(names)} from ({queries.OP9}) x").fetchall()
    assert sorted(rows) == sorted(map(tuple, queries.op9_url_filters(spark, str(tmp_path)).select(*names).collect()))
    assert sum(r[2] for r in rows) > 5
    want = set()
    for e in events.event_id:
        slots = {(e * 7 + j * 1013) % 12 for j in range(4)}
        want |= {(f"list{e % 3}", ".".join(h.split(".")[-2:]) if e % 5 == 0 else h, e / 4) for p, h in zip(ids, hosts) if p % 12 in slots}
    got = queries.page_entries(spark, str(tmp_path)).select("list_name", "key", "weight").collect()
    assert set(map(tuple, got)) == want and len({w for *_, w in want}) > 40


def test_a_capture_meets_few_of_a_long_history(spark):
    url_lists = pytest.importorskip("lodestrata.llm.url_lists")
    start, gaps = pd.Timestamp("2023-12-30 23:58:20"), (0.5, 7, 61, 900, 3600, 7000, 90_000, 4_000_000)
    at, entries = start, []
    for i in range(400):
        entries.append((f"l{i % 2}", "bad.org", ("block", "allow", "remove")[i % 3], float(i), at))
        at += pd.Timedelta(seconds=gaps[i * i % 8] if i % 50 else gaps[-1])
    captures = [(i, "http://bad.org/", start + pd.Timedelta(seconds=i * 9_731.25 % 30_000_000)) for i in range(900)] + [(900 + i, "http://bad.org/", e[4]) for i, e in enumerate(entries)]
    e = spark.createDataFrame([(*x, str(t)) for *x, t in entries], "list_name string, key string, action string, weight double, effective string")
    c = spark.createDataFrame([(*x, str(t)) for *x, t in captures], "page_id long, url string, fetched string")
    got = {r.page_id: (r.lists, r.allowed, r.blocked) for r in url_lists.as_of(c, e).collect()}
    for page, _, t in captures:
        last = {}
        for name, _, action, _, when in entries:
            if when <= t:
                last[name] = action
        held = {n: a for n, a in last.items() if a != "remove"}
        assert got[page] == (",".join(sorted(held)), "allow" in held.values(), "block" in held.values())
    held = url_lists.intervals(e).where("valid_to is not null").select("valid_from", "valid_to", F.explode(url_lists.cells(F.col("valid_from"), F.col("valid_to"))).alias("cell"))
    most = held.groupBy("cell").count().agg(F.max("count")).first()[0]
    assert {r.width for r in held.select("cell.width").distinct().collect()} == set(url_lists.WIDTHS) and most < 100
