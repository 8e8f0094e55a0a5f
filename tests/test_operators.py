"""Rules of single operators on small inputs."""

import datetime as dt
import hashlib
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import AccumulatorParam
from pyspark.sql import functions as F

from lodestrata.functions import filters
from lodestrata.functions import text as t
from lodestrata.operators import entities as en
from lodestrata.operators import nearness
from lodestrata.operators import postprocess as pp
from lodestrata.operators import resolution, rollups, search, segment, state, summary
from lodestrata.operators import vectors as ve
from lodestrata.sources import documents as dc
from lodestrata.sources import tables as tb
from lodestrata.streaming import ingest


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("a \r\nb\r\n\r\n\r\n\r\nc  d ", "a\nb\n\nc d"), ("\t x \n", "x"), ("", "")])
def test_clean(spark, text, want):
    assert one(spark, t.clean(F.col("a")), a=text) == want


def test_scalars(spark):
    assert one(spark, t.squeeze(F.col("a")), a="x" * 50 + "yy") == "x" * 20 + "yy"
    assert one(spark, t.compact_ascii(F.col("a")), a="Müller-GmbH") == "mllergmbh"
    assert one(spark, t.compact_unicode(F.col("a")), a="Müller-GmbH") == "müllergmbh"
    assert one(spark, t.cluster_key(F.col("a"), F.lit("ORG")), a="Acme Corp.") == "acmecorp::org"
    assert one(spark, t.cluster_key(F.col("a"), F.lit("ORG")), a=" -- ") == "--::org"
    assert one(spark, t.mime_label(F.col("a")), a="application/vnd.custom-thing") == "CUSTOM-THING"
    assert one(spark, t.mime_of_name(F.col("a")), a="x/Y.JPEG") == "image/jpeg"
    assert [one(spark, t.clock(F.col("a")), a=v) for v in (2.5, 3661.0, float("nan"), -1.0)] == ["00:00:02", "01:01:01", "00:00:00", "00:00:00"]
    assert [one(spark, t.seconds(F.col("a")), a=v) for v in ("01:02:03.5", "02:03", "7", "99:99", "x")] == [3723.5, 123.0, 7.0, None, None]
    answers = {
        "<think>no</think> yes": "yes", "thought </think> yes": "yes", "yes <THINK x> cut sh": "yes", "a </think> b <think> c": "b", "<think>a</think >b<think>c</think>d": "bd", "<thinking>stays": "<thinking>stays",
        "<|channel|>analysis<|message|>hm<|end|><|start|>assistant<|channel|> final <|message|> yes <|return|>": "yes", "<|channel|>analysis<|message|>hm<|end|> yes": "yes", "yes": "yes", "": "",
    }
    assert {a: one(spark, t.without_reasoning(F.col("a")), a=a) for a in answers} == answers
    thoughts = {"<think> no </think> yes <think> cut": "no\ncut", "x </think> y": "x", "<|channel|>analysis<|message|> hm <|end|><think>so</think>": "hm\nso", "yes": None}
    assert {a: one(spark, t.reasoning(F.col("a")), a=a) for a in thoughts} == thoughts
    assert [one(spark, t.no_image_refusal(F.col("a")), a=a) for a in ("Sorry, I  DON'T\nsee an image.", "Please share the image", "Please share the image" + "x" * 160, "A cat")] == [True, True, False, False]
    assert one(spark, t.understood(F.col("a")), a="Which rows are on Page 12?").asDict() == {"intent": "table", "confidence": 0.8, "reason": "matched keywords for table", "query": "Which rows are on Page 12?", "page": "12"}
    assert one(spark, t.weak_answer(F.col("a")), a="Dazu gibt es leider keine Informationen in den Dokumenten") and not one(spark, t.weak_answer(F.col("a")), a="The answer is long enough, and it says what was asked for.")
    assert one(spark, t.reasoning(F.col("a")), a="<think> no </think> yes") == "no"
    assert one(spark, t.clamped(F.col("a"), 3), a="a\n\tbcd") == "a b… [truncated]"
    assert one(spark, t.strip_counter(F.col("a")), a="id_1_22") == "id_1"
    assert one(spark, t.readable_bytes(F.col("a")), a=1536) == "1.5 KB"
    assert (one(spark, t.counter(F.col("a"), 1), a="page 3 / 10"), one(spark, t.counter(F.col("a"), 2), a="none")) == (3, None)
    assert one(spark, t.weak_answer(F.col("a")), a="short") and one(spark, t.intent(F.col("a")), a="Summarise it: an overview") == "summary"


ROWS = [(1, "text/plain", 5.0, "2024-01-05T12:00:00", ["a", "B c"], '{"k": {"v": "7"}}'), (2, None, None, None, None, None), (3, "image/png", 10.0, "2024-01-04", [" a "], '{"k": {"v": 3}}')]


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame(ROWS, "id long, mime string, page double, at string, tags array<string>, props string").cache()


@pytest.mark.parametrize("rule,want", [
    ({"field": "mime", "operator": "eq", "value": " text/plain "}, [1]), ({"field": "mime", "operator": "neq", "value": "text/plain"}, [2, 3]),
    ({"field": "tags", "operator": "eq", "value": "a"}, [1, 3]), ({"field": "tags", "operator": "contains", "value": "b C"}, [1]),
    ({"field": "page", "operator": "gte", "value": "10"}, [3]), ({"field": "page", "operator": "lt", "value": 7}, [1]), ({"field": "page", "operator": "eq", "value": "5"}, []),
    ({"field": "mime", "operator": "in", "values": ["image/png", "x"]}, [3]), ({"field": "mime", "operator": "mime_match", "value": "IMAGE/*"}, [3]),
    ({"field": "at", "operator": "date_after", "value": "2024-01-05"}, [1]), ({"field": "at", "operator": "date_before", "value": "2024-01-05"}, [1, 3]),
    ({"field": "props.k.v", "operator": "gt", "value": 5}, [1]), ({"fields": ["mime", "at"], "operator": "eq", "value": "2024-01-04"}, [3]),
    ({"field": "nowhere", "operator": "neq", "value": "x"}, [1, 2, 3]), ({"field": "nowhere", "operator": "eq", "value": "x"}, []), ({"operator": "eq", "value": 1}, [1, 2, 3]),
])
def test_filter_rules(meta, rule, want):
    assert sorted(r.id for r in filters.matching(meta, [rule]).collect()) == want


def test_strict_rules_raise(meta):
    for rule in ({"operator": "eq", "value": 1}, {"field": "page", "operator": "gt", "value": "x"}, {"field": "page", "operator": "like", "value": 1}):
        with pytest.raises(ValueError):
            filters.predicate(meta, [rule], strict=True)


@pytest.mark.parametrize("rule,want", [
    ({"field": "ts", "operator": "date_on_or_after", "value": "2024-01-05"}, "GreaterThanOrEqual(ts"), ({"field": "user_id", "operator": "gt", "value": "7"}, "GreaterThan(user_id,7)"),
    ({"field": "event_type", "operator": "eq", "value": "error"}, "StringContains(event_type,error)"),
])
def test_filters_reach_the_scan(spark, rule, want):
    df = filters.matching(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), [rule]).select("event_id")
    assert want in df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1]


def test_keywords_and_phrases(spark):
    assert search.keywords("Berlin berlin BERLIN a") == ["Berlin"] and search.keywords("a b c") == []
    rows = spark.createDataFrame([("1", "Der Parteitag, ein  Tag", "u1"), ("2", "Partei", "235"), ("3", None, None)], "node_id string, text string, uuid string")
    found = lambda q, ids=(): sorted(r.node_id for r in search.find(rows, q, ["text"], list(ids)).collect())
    assert found("partei") == ["1", "2"] and found("tag") == ["1"] and found("eitag") == [] and found("a b") == [] and found("ein tag") == ["1"] and found("tag ein") == []
    assert found("235", ["uuid"]) == ["2"] and found("x 235", ["uuid"]) == []
    assert len(search.value_forms("0123456789abcdef0123456789ABCDEF")) == 3
    assert search.decode_cursor(search.encode_cursor("n:1"))["after"] == "n:1"
    with pytest.raises(ValueError):
        search.decode_cursor("!!")


def test_pages_go_on_behind_the_cursor(spark):
    df = spark.range(10).toDF("id")
    seen, cursor = [], None
    while got := [r.id for r in search.page(df, "id", 4, cursor).collect()]:
        seen += got
        cursor = search.encode_cursor(got[-1])
    assert seen == list(range(10))


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, ["PERSON", None, "ORG"], 'say "hi", ok'), (2, None, None)], "id long, types array<string>, text string").coalesce(1)
    search.write_csv(df, str(tmp_path / "out"))
    got = pd.concat([pd.read_csv(p, keep_default_na=False) for p in (tmp_path / "out").glob("*.csv")]).sort_values("id")
    assert got.values.tolist() == [[1, "PERSON;ORG", 'say "hi", ok'], [2, "", ""]]


MENTIONS = "doc_id long, ord int, filename string, kind string, pos int, text string, score double"


def test_entities(spark):
    found = spark.createDataFrame([(1, 1, "docA.pdf", "ORG", 0, "Acme Corp", 0.9), (1, 2, "docA.pdf", "org", 0, "acme corp", 0.8), (1, 2, "docA.pdf", "LOC", 1, "Rivertown", None), (2, 0, "docB.pdf", "LOC", 0, " Rivertown ", 0.5), (2, 0, "docB.pdf", None, 1, " ", 0.1)], MENTIONS)
    m = en.normalized(found)
    got = {r.text: r for r in en.top(en.aggregate(m)).collect()}
    assert len(got) == 2 and (got["Acme Corp"].mentions, got["Acme Corp"].best_score, got["Acme Corp"].type, got["Acme Corp"].source_count) == (2, 0.9, "ORG", 1)
    assert (got["Rivertown"].mentions, got["Rivertown"].best_score, got["Rivertown"].source_count) == (2, 0.5, 2)
    assert {r.text for r in en.variants(m).collect()} == {"Acme Corp", "acme corp"}
    assert en.search(en.aggregate(m), "acme").first().match_rank == 2 and en.search(en.aggregate(m), "ac").first().match_rank == 1


def test_graph_scores(spark):
    e = spark.createDataFrame([("a", "b", 4), ("b", "c", 2), ("a", "d", 1), ("c", "d", 6)], "source string, target string, weight long")
    got = {r.key: (r.score, r.depth) for r in en.neighbours(e, "a").collect()}
    # first a-b and a-d, then all edges of b and d that don't end in a
    assert got == {"b": (4.0, 1), "d": (1.0, 1), "c": (2 / 2 + 6 / 2, 2)}


def test_manifest(spark):
    ev = spark.createDataFrame([("c", "h1", "started", 1, None), ("c", "h1", "completed", 2, None), ("c", "h1", "started", 3, None), ("c", "h2", "completed", 1, None), ("c", "h2", "failed", 2, "e" * 600), ("c", "h3", "started", 5, None)], "collection string, file_hash string, status string, at long, error string")
    got = {r.file_hash: r for r in state.merge_manifest(ev).collect()}
    assert {k: r.status for k, r in got.items()} == {"h1": "completed", "h2": "failed", "h3": "in_progress"}
    assert got["h1"].started_at == 1 and len(got["h2"].error) == 512


def test_state_tables(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q" * 60), (1, 1, "assistant", "a"), (1, 2, "user", "b"), (2, 0, "assistant", "hello")], "conv_id long, turn long, role string, text string")
    s = {r.conv_id: r for r in state.sessions(turns).collect()}
    assert s[1].title == "q" * 50 + "..." and s[2].title is None and s[1].turns == 3
    x = state.exchanges(turns).orderBy("number").collect()
    assert [(r.number, r.answer, r.prior_question) for r in x] == [(1, "a", None), (2, None, "q" * 60)]
    items = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "id string, position int")
    assert [r.id for r in state.reorder(items, "id", "position", ["z"]).orderBy("position").collect()] == ["z", "x", "y"]
    assert state.insert_missing(items, spark.createDataFrame([("x", 9), ("w", 4), ("w", 4)], "id string, position int"), ["id"]).count() == 4
    assert state.transcript(turns).where("conv_id = 2").first().markdown == "**assistant:** hello"


def test_packing_of_parents(spark):
    hits = spark.createDataFrame([(1, 1, "c1", "p1", 50, 5), (1, 2, "c2", "p1", 50, 5), (1, 3, "c3", "p2", 80, 5), (1, 4, "c4", None, None, 5), (1, 5, "c5", "p3", 40, 5)], "query_id long, position int, node_id string, parent_id string, parent_tokens long, child_tokens long")
    assert [(r.node_id, r.shown) for r in pp.pack_parents(hits, 100).orderBy("position").collect()] == [("p1", "parent"), ("c3", "child"), ("c4", "hit"), ("p3", "parent")]


def test_links_and_scope(spark):
    hits = spark.createDataFrame([("k1", "a")], "key string, node string")
    rows = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k1", "c"), ("k2", "d")], "key string, node string")
    assert [(r.node, r.link_rank) for r in pp.follow_links(hits, rows, "key", "node", 1).collect()] == [("b", 1)]
    assert [r.found for r in pp.scoped(["d", "x", "a"], rows, hits, "node").orderBy("position").collect()] == ["main", "missing", "main"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.integers(5, 60))
def test_windows_and_budgets_follow_their_models(spark, sizes, most):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "u long, i long, n long").coalesce(1)
    at, used, want = 0, 0, []
    for n in sizes:
        if used and used + n > most:
            at, used = at + 1, 0
        used += n
        want.append(at)
    assert [r.window for r in summary.windows(df, "u", "i", "n", most).orderBy("i").collect()] == want
    given_out = [(r.i, r.allowance) for r in summary.allocate(df, "u", "i", "n", most).collect()]
    assert sum(a for _, a in given_out) <= most and all(a <= sizes[i] for i, a in given_out)


def test_units_do_not_depend_on_input_order(spark):
    rows = [(i % 3, i, f"text {i}") for i in range(30)]
    a, b = ({r.unit_key: r.fingerprint for r in summary.units(spark.createDataFrame(x, "u long, i long, text string").repartition(k), F.col("u"), ["i"]).collect()} for x, k in ((rows, 3), (random.Random(1).sample(rows, 30), 5)))
    assert a == b
    new = spark.createDataFrame(list(a.items()), "unit_key long, fingerprint string")
    assert [r.unit_key for r in summary.stale(new, new.where("unit_key < 2")).collect()] == [2]


def test_chunking(spark):
    text = "One sentence. " * 40 + "\n\n" + "Another paragraph! " * 30
    out = segment.hierarchy(spark.createDataFrame([(1, text), (2, None), (3, "x" * 3000)], "doc_id long, text string"), 400, 100).collect()
    assert max(len(r.text) for r in out if r.hier_type == "fine") <= 100 and max(len(r.text) for r in out if r.hier_type == "coarse") <= 400
    parents = {r.node_id for r in out if r.hier_type == "coarse"}
    assert all(r.parent_id in parents for r in out if r.hier_type == "fine")
    joined = "".join("".join(r.text.split()) for r in sorted((r for r in out if r.doc_id == 1 and r.hier_type == "fine"), key=lambda r: r.part))
    assert joined == "".join(text.split())
    parts = segment.budget_split(spark.createDataFrame([("a", "word " * 200), ("b", "short")], "node_id string, text string"), 40).collect()
    assert {(r.node_id, r.total_parts) for r in parts} == {("a", len([r for r in parts if r.node_id == "a"])), ("b", 1)}


def test_html_tables(spark):
    html = "<table><tr><th colspan=2>H</th></tr><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>"
    got = segment.html_grids(spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id long, html string"))
    assert [r.grid for r in got.collect()] == [[["H", "H"], ["a", "b"], ["a", "c"]]]
    assert got.select(segment.grid_text(F.col("grid")).alias("x")).first().x == "H | H\na | b\na | c"


def test_resolution(spark):
    rows = [("Acme", "ORG", 5, [1.0, 0.0]), ("ACME", "org", 3, [0.0, 1.0]), ("Acme Inc", "ORG", 2, [0.99, 0.1]), ("Acme", "LOC", 1, [1.0, 0.0])]
    got = {(r.surface, r.entity_type): r for r in resolution.resolve(spark.createDataFrame(rows, "surface string, entity_type string, mentions long, embedding array<double>")).collect()}
    assert [got[k].action for k in (("Acme", "ORG"), ("ACME", "org"), ("Acme Inc", "ORG"), ("Acme", "LOC"))] == ["minted", "skipped", "attached", "minted"]
    assert got[("Acme Inc", "ORG")].entity_id == got[("Acme", "ORG")].entity_id


def test_greedy_selection(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0], 0.9), (1, 2, [1.0, 0.01], 0.89), (1, 3, [0.0, 1.0], 0.5)], "query_id long, vec_id long, embedding array<double>, score double")
    assert [r.vec_id for r in ve.mmr(v, 2).orderBy("pick").collect()] == [1, 3]
    assert sorted(r.vec_id for r in ve.prune_near(v, "query_id").collect()) == [1, 3]


def greedy(x, threshold, digits=9):
    kept = []
    for i in range(len(x)):
        if not kept or np.round(x[kept] @ x[i], digits).max() < threshold:
            kept.append(i)
    return kept


def clouds(n, seed=3):
    """Vectors of a hot label (near copies, exact copies, a vector of no length) and of a small one without a name."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8)) + 2 * rng.normal(size=(6, 8))[rng.integers(6, size=n)]
    x[n // 3 : n // 2] = x[n // 4]
    x[[5, n - 1]] = 0
    return x, [None if i % 10 == 0 else 7 for i in range(n)]


def test_pruning_of_a_large_set_is_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(nearness, "FEW", 40)
    x, labels = clouds(600)
    v = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(zip(x.tolist(), labels))], "vec_id long, embedding array<double>, label int")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = set()
    for label in (7, None):
        own = np.array([i for i, c in enumerate(labels) if c == label])
        want |= {(label, int(own[i])) for i in greedy(unit[own], 0.8)}
    assert {(r.label, r.vec_id) for r in ve.prune_near(v, "label", 0.8).collect()} == want
    plain = nearness.meet
    monkeypatch.setattr(nearness, "meet", lambda a, b, match, schema: plain(a, b, lambda p, q: (seen.add(max(len(p), len(q))), match(p, q))[1], schema))
    seen = spark.sparkContext.accumulator(0, Largest())
    r = nearness.numbered(v.select("vec_id", F.col("embedding").alias("v"), F.to_json(F.struct("label")).alias("g")), [F.col("g"), F.col("vec_id")])
    assert nearness.independent(r, 0.8, first=64).count() == len(want) and 0 < seen.value < 100


class Largest(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)


def test_resolution_of_a_large_type_is_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(nearness, "FEW", 40)
    x, _ = clouds(300)
    rows = [(f"Name {i % 280}" if i % 3 else f" nAME {i % 280} ", "ORG", i * 7 % 11, x[i].tolist()) for i in range(300)]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    known, kept, want = {}, [], []
    for i in sorted(range(300), key=lambda i: (-rows[i][2], rows[i][0])):
        name = f"org:{rows[i][0].strip().casefold()}"
        sims = np.round(unit[kept] @ unit[i], 6)
        if name in known:
            want.append((rows[i][0], known[name], "skipped", 1.0))
            continue
        near = len(kept) and sims.max() >= 0.8
        j = kept[int(np.argmax(sims))] if near else i
        if not near:
            kept.append(i)
        known[name] = known[f"org:{rows[j][0].strip().casefold()}"] if near else hashlib.sha256(name.encode()).hexdigest()[:16]
        want.append((rows[i][0], known[name], "attached" if near else "minted", float(sims.max()) if near else 0.0))
    plain, seen = nearness.meet, spark.sparkContext.accumulator(0, Largest())
    monkeypatch.setattr(nearness, "meet", lambda a, b, match, schema: plain(a, b, lambda p, q: (seen.add(max(len(p), len(q))), match(p, q))[1], schema))
    got = resolution.resolve(spark.createDataFrame(rows, "surface string, entity_type string, mentions long, embedding array<double>"), 0.8).collect()
    assert sorted((r.surface, r.entity_id, r.action, r.similarity) for r in got) == sorted(want)
    assert {r.action for r in got} == {"minted", "attached", "skipped"} and 0 < seen.value < 100


def test_tables(spark, tmp_path):
    assert [tb.separator(x) for x in ("a;b\n1;2\n", "a,b\n1,2\n", "a\tb\n1\t2\n", "word")] == [";", ",", "\t", ","]
    (tmp_path / "a.csv").write_text("title;category\nHello world;x\n;y\n")
    got = tb.rows(tb.read(spark, str(tmp_path / "a.csv"))).collect()
    assert [(r.text, r.metadata) for r in got] == [("Hello world", '{"category":"x"}')]
    assert tb.profile([c.upper() for c in tb.PROFILES["messages"]]) == "messages" and tb.profile(["a"]) is None and tb.is_media_manifest(["Media ID ", "exported media filename", "x"])
    row = {c: c.lower() for c in tb.PROFILES["comments"]}
    social = tb.rows(spark.createDataFrame(pd.DataFrame([row]))).first()
    assert social.reference_metadata.type == "comment" and social.reference_metadata.text_id == "comment id" and social.text == "text content"
    manifest = spark.createDataFrame([("p1_3", "d/A.JPG"), ("p9", "b.jpg"), ("p2", "none.jpg")], ["Media ID", "Exported media filename"])
    postings = spark.createDataFrame([("p1", "u1"), ("p2", "u2")], ["Posting ID", "UUID"])
    files = spark.createDataFrame([("/x/a.jpg",), ("/x/b.jpg",)], ["path"])
    assert [(r.posting_uuid, r.path) for r in tb.media_links(manifest, postings, files).collect()] == [("u1", "/x/a.jpg")]


def test_json_and_transcripts(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"text": " one ", "start_ts": "00:00:01", "end_ts": "00:00:02"}\n{"text": "", "start_seconds": 3}\n{"text": "two", "start_seconds": 2.5, "end_seconds": 4}\n')
    df = spark.read.json(str(tmp_path / "t.jsonl"))
    assert dc.is_transcript(df)
    got = dc.transcript(df).orderBy("sentence_index").collect()
    assert [(r.sentence_index, r.text, r.start_seconds, r.start_ts) for r in got] == [(0, "one", 1.0, "00:00:01"), (1, "two", 2.5, "00:00:02")]
    (tmp_path / "a.json").write_text('[{"a": {"b": [{"c": 1}]}}, {"d": 2}]')
    out = dc.json_documents(spark, str(tmp_path / "a.json")).collect()
    assert len(out) == 2 and out[0].nested_keys == "a,a.b,a.b.c,d"


def test_transcripts_of_any_length_stay_whole(spark):
    turns = spark.range(50_010).select(F.lit("t").alias("text"), F.col("id").cast("double").alias("start_seconds"), F.col("id").cast("double").alias("end_seconds"), F.lit("f").alias("source_file"))
    assert dc.transcript(turns).agg(F.count("*").alias("n"), F.max("sentence_index").alias("last")).first()[:] == (50_010, 50_009)
    assert dc.transcript(turns, most=7).count() == 7


def test_office_files(spark, tmp_path):
    (tmp_path / "a.rtf").write_bytes(rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b bold\b0\par caf\'e9 \u8364?{\*\hidden x}}")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r.path[-6:]: r for r in dc.files(spark, str(tmp_path)).collect()}
    assert got["/a.rtf"].text == "Hello bold\ncafé €" and got["b.docx"].text == "One\na | b" and got["c.xlsx"].text == "name |  | 5" and got["d.docx"].text is None
    known = spark.createDataFrame([(got["/a.rtf"].file_hash,)], ["file_hash"])
    assert dc.files(spark, str(tmp_path), known).count() == 3


def test_rollups(spark):
    c = spark.createDataFrame([(1, 0, "f", "h1", "abc"), (1, 1, "f", "h1", None), (2, 0, "g", "h2", "x")], "doc_id long, ord int, filename string, file_hash string, text string")
    assert {(r.filename, r.node_count, r.page_count, r.file_hash) for r in rollups.documents(c).collect()} == {("f", 2, 1, "h1"), ("g", 1, 1, "h2")}
    assert rollups.coverage(c, "text").first().asDict() == {"total": 3, "indexed": 2, "missing": 1, "status": "partial"}
    r = spark.createDataFrame([("m", 1, [1, 2]), ("m", 2, [3]), ("m", 3, [4])], "mode string, query_id long, found array<long>")
    e = spark.createDataFrame([(1, [2]), (2, [9])], "query_id long, wanted array<long>")
    assert rollups.hit_rates(r, e).first().asDict() == {"mode": "m", "queries": 3, "expected_queries": 2, "hit_rate": 0.5}


def test_streaming_ingest_is_incremental_and_repeatable(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    where = [str(tmp_path / x) for x in ("chunks", "manifest", "checkpoint")]

    def run():
        ingest.ingest(ingest.stream_documents(spark, str(tmp_path / "in"), schema), *where).awaitTermination()
        return spark.read.parquet(where[0]).count(), {r.status for r in ingest.manifest(spark, where[1]).collect()}, ingest.manifest(spark, where[1]).count()

    add([(1, "one\n\ntwo", "en", "s", 3), (2, "one\n\ntwo", "en", "s", 3)])
    assert run() == (2, {"completed"}, 1)
    add([(3, "three", "en", "s", 3), (4, "one\n\ntwo", "en", "s", 3)])
    assert run() == (3, {"completed"}, 2)
    assert run() == (3, {"completed"}, 2)


def test_hourly_windows_with_a_watermark(spark, tmp_path):
    ts = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    spark.createDataFrame([(ts(1, 5), "a", 1.0), (ts(1, 50), "a", 2.0), (ts(9, 0), "b", 5.0)], "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = ingest.hourly(s).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.events, r.value) for r in spark.table("hours").collect()} == {("a", 2, 3.0), ("b", 1, 5.0)}


def test_references_follow_their_export(spark):
    def row(kind, **cells):
        names = tb.PROFILES[kind]
        df = spark.createDataFrame([tuple(cells.get(n.replace(" ", "_").replace("-", "_")) for n in names)], ", ".join(f"`{n}` string" for n in names))
        return tb.rows(df).first()

    m = row("messages", UUID="u1", Chat_ID="chat-1", Sender="Bob", Timestamp="2026-02-03T11:00:00Z", Text="Message body", URL="https://e", Reply_To="root", Network="Signal")
    assert m.doc_id == "chat-1" and m.style == "messages"
    assert m.reference_metadata.asDict() == {"type": "message", "network": "Signal", "uuid": "u1", "timestamp": "2026-02-03T11:00:00Z", "author": "Bob", "author_id": None, "vanity": None, "text": "Message body", "text_id": "chat-1", "parent_text": "root", "anchor_text": None}
    c = row("comments", Comment_ID="c1", Text_Content="Comment body", Posting_Text="post", Parent_Comment_Text="parent", URL="https://e").reference_metadata
    assert (c.text_id, c.parent_text, c.anchor_text, c.type) == ("c1", "parent", "post", "comment") and "url" not in c.asDict()
    p = row("postings", Posting_ID="p1", Text_Content="Posting body", URL="https://e").reference_metadata
    assert (p.text_id, p.url, p.parent_text, p.anchor_text) == ("p1", "https://e", None, None)


# -- labels, lanes and logs


def test_window_of_a_parent():
    from lodestrata.operators.postprocess import window

    parent = " ".join(f"word{i}" for i in range(200))
    got = window(parent, "word100", 60)
    assert "word100" in got and len(got) <= 60 and all(w in parent.split() for w in got.split())
    assert window(parent, "word0", 40).startswith("word0 ") and window(parent, "word199", 40).endswith("word199")
    assert "word7 word8" in window(parent, "word7\n  word8", 60)
    assert window(parent, "nowhere", 60) is None and window(None, "a", 9) is None and window("a", None, 9) is None and window("a", "a", 0) is None
    assert window("abcdef", "abcdef", 4) == "abcd"
    assert window("x" * 500 + "needle" + "y" * 500, "needle", 26) == "x" * 10 + "needle" + "y" * 10


def test_labels_of_odd_values(spark):
    from lodestrata.functions import labels as lb

    one = spark.range(1)
    s = lambda v: F.lit(v).cast("string")
    got = one.select(
        lb.source_label(s(" "), s(None), s(None)).alias("a"), lb.source_line(s(""), s(None), s("4")).alias("b"), lb.markdown_cell(s(None)).alias("c"), lb.date_only(s("no day at all")).alias("d"),
        lb.has_blank(s("")).alias("e"), lb.file_fragment(s("/__/")).alias("f"), lb.elapsed(F.lit(float("nan"))).alias("g"), lb.elapsed(F.lit(90061.9)).alias("h"),
        lb.caption(s("printed"), s(" "), F.array(F.lit("a"), F.lit("b"))).alias("i"), lb.caption(s(None), s(None), F.array().cast("array<string>")).alias("j"),
        lb.evidence(s("EVIDENCE_INDICES: 3\nmore\nEVIDENCE_INDICES: 9, 2"), F.array(F.lit("x"), F.lit("y"))).alias("k"), lb.clarification(F.lit(0.1), F.array(F.lit("x")), F.lit(2)).alias("l"), lb.number(s("x")).alias("m"),
    ).first()
    assert tuple(got) == ("Unknown", "(Row 4)", "", "no day at ", True, "collection", "00:00", "1d 01:01:01", "printed\n\nTags: a, b", "", ["y"], None, None)


def test_totals_of_phrases_and_unknown_fields(spark):
    df = spark.createDataFrame([("a b", "xy"), ("a", "yz")], "text string, author string")
    assert search.total(search.by_field(df, "text", "a b"), "a b").first().total is None
    assert search.total(search.by_field(df, "author", "xy"), "xy").first().total == 1
    assert search.by_field(df, "author", "x").count() == 0 and search.by_field(df, "network", "xy").count() == 0
    with pytest.raises(ValueError):
        search.by_field(df, "lang", "x")


def test_stores_and_bumps_of_a_summary(spark):
    log = [("c", 1, "store", 0, "first"), ("c", 2, "bump", None, None), ("c", 3, "store", 0, "late"), ("d", 1, "bump", None, None), ("d", 2, "store", 1, "good"), ("e", 1, "store", 7, "never")]
    got = {r.collection: (r.revision, r.payload) for r in state.published(spark.createDataFrame(log, "collection string, at int, kind string, expected int, payload string")).collect()}
    assert got == {"c": (1, None), "d": (1, "good"), "e": (0, None)}
