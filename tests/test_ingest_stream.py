"""Ingest by stream: failing texts, batches that are run again, transcripts that are made once."""

from lodestrata.operators import plugs
from lodestrata.sources import tables
from lodestrata.streaming import ingest, transcripts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def add(spark, tmp_path, rows):
    spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_failing_texts_leave_others_whole_and_are_tried_again(spark, tmp_path):
    down = tmp_path / "down"
    down.touch()

    def call(client, rows):
        import os

        if any("bad" in r["text"] for r in rows) and os.path.exists(str(down)):
            raise RuntimeError("service down")
        return [len(r["text"]) for r in rows]

    where = [str(tmp_path / x) for x in ("chunks", "manifest", "checkpoint")]

    def run():
        ingest.ingest(ingest.stream_documents(spark, str(tmp_path / "in"), DOCS), *where, enrich=plugs.Plug(call, "long", retries=0)).awaitTermination()
        return {r.text: r.enriched for r in spark.read.parquet(where[0]).collect()}, {r.file_hash: r for r in ingest.manifest(spark, where[1]).collect()}

    add(spark, tmp_path, [(1, "one\ntwo"), (2, "good\nbad line"), (3, None), (4, " \n"), (5, "one\ntwo")])
    chunks, files = run()
    assert chunks == {"one": 3, "two": 3} and sorted(r.status for r in files.values()) == ["completed", "failed", "failed"]
    assert {r.error for r in files.values() if r.status == "failed"} == {"RuntimeError: service down", "no text"}
    assert all(r.started_at <= r.updated_at for r in files.values())
    started = {h: r.started_at for h, r in files.items()}
    down.unlink()
    add(spark, tmp_path, [(9, "good\nbad line"), (10, "one\ntwo")])
    chunks, files = run()
    assert chunks == {"one": 3, "two": 3, "good": 4, "bad line": 8} and sorted(r.status for r in files.values()) == ["completed", "completed", "failed"]
    assert {h: r.started_at for h, r in files.items()} == started  # the first start stays
    assert run()[0] == chunks


def test_a_batch_that_is_run_again_writes_its_rows_again(spark, tmp_path):
    where = [str(tmp_path / x) for x in ("chunks", "manifest")]
    add(spark, tmp_path, [(1, "one"), (2, "two")])
    for i in range(2):  # a new checkpoint starts from batch 0 again, as if its first run had not been committed
        ingest.ingest(ingest.stream_documents(spark, str(tmp_path / "in"), DOCS), *where, str(tmp_path / f"check{i}")).awaitTermination()
        assert spark.read.parquet(where[0]).count() == 2 and {r.status for r in ingest.manifest(spark, where[1]).collect()} == {"completed"}


def test_transcripts_are_made_once_and_claimed_media_are_left_out(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def call(client, rows):
        for r in rows:
            if r["content"] == b"broken":
                raise ValueError("no sound")
            (calls / f"{r['content'].decode()}-{len(list(calls.iterdir()))}").touch()
        return ["said " + r["content"].decode() for r in rows]

    cache = transcripts.cache_table(str(tmp_path / "cache"), 4)
    media = lambda *rows: spark.createDataFrame([(p, c.encode()) for p, c in rows], "path string, content binary")
    claimed = spark.createDataFrame([("/d/claimed.mp4",)], "path string")
    plug = plugs.Plug(call, "string", batch=1, retries=0)
    got = transcripts.transcribe(media(("/d/a.mp3", "a"), ("/d/copy.mp3", "a"), ("/d/claimed.mp4", "c"), ("/d/x.mp3", "broken")), cache, plug, claimed)
    assert {r.path: (r.transcript, r.cached, r.error) for r in got.collect()} == {"/d/a.mp3": ("said a", False, None), "/d/copy.mp3": ("said a", False, None), "/d/x.mp3": (None, False, "ValueError: no sound")}
    assert len(list(calls.iterdir())) == 1
    got = transcripts.transcribe(media(("/e/again.mp3", "a"), ("/e/b.mp3", "b")), cache, plug, claimed)
    assert {r.path: (r.transcript, r.cached) for r in got.collect()} == {"/e/again.mp3": ("said a", True), "/e/b.mp3": ("said b", False)}
    assert len(list(calls.iterdir())) == 2 and cache.read(spark).count() == 2
    media(("/f/1", "a"), ("/f/2", "z")).write.parquet(str(tmp_path / "media"))
    stream = spark.readStream.schema("path string, content binary").parquet(str(tmp_path / "media"))
    for i in range(2):
        transcripts.follow(stream, cache, plug, str(tmp_path / "out"), str(tmp_path / f"c{i}"), claimed).awaitTermination()
        assert {r.path: r.transcript for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"/f/1": "said a", "/f/2": "said z"}
    assert len(list(calls.iterdir())) == 3


def test_posting_references(spark):
    def export(*rows):
        names = tables.PROFILES["postings"]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n.upper()}` string" for n in names))

    df = export({"Posting ID": " p1 ", "Network": "Net", "Author": "Alice", "Text Content": " "}, {"Posting ID": "p2", "URL": "http://x", "Vanity Name": "v"}, {"Posting ID": " ", "Network": "Net"})
    assert {r.posting_id: r.reference for r in transcripts.posting_references(df).collect()} == {"p1": {"posting_network": "Net", "posting_author": "Alice"}, "p2": {"posting_url": "http://x", "posting_vanity": "v"}}
    assert transcripts.posting_references(df.drop("TAGS")).count() == 0
