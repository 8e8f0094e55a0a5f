"""Source rows, texts of sources under a budget, and bundles of reports against plain loops."""

import json
import random

from lodestrata.operators import answers, state


def test_source_rows_of_payloads(spark):
    payloads = [
        {"origin": {"filename": "a.pdf", "mimetype": "application/pdf", "file_hash": "h1"}, "text": "  body  ", "page_number": 3, "source": "document", "chunk_id": "c1", "citation_index": 2},
        {"file_name": "b.csv", "file_type": "csv", "metadata": {"origin": {"file_hash": "h2"}}, "source": "table", "table": {"row_index": 0, "n_rows": 9, "n_cols": 2, "style": "postings"}, "chunk": "row text"},
        {"source_path": "/x/y/img.png", "source_doc_id": "h3", "image_id": "i1", "llm_description": "A cat", "llm_tags": ["cat", "sofa"]},
        {"_node_content": json.dumps({"text": "inner"}), "provenance": [{"page_no": None}, {"page_no": 7}], "doc_kind": "transcript_segment", "sentence_index": 4},
        {"text": " ", "doc_items": [{"prov": None}, {"prov": [{"page_no": 5}]}], "page": "x", "meta": {"file_hash": "h4"}, "posting_uuid": "u"},
        {"page": 0, "origin": {"page_no": 0}, "content": "c" * 300},
    ]
    df = spark.createDataFrame([(f"n{i}" if i else None, json.dumps(p)) for i, p in enumerate(payloads)] + [("n8", None), ("n9", "no json")], "node_id string, payload string")
    got = answers.source_rows(df, "col").collect()
    a, b, c, d, e, f, g, h = got
    assert (a.text, a.filename, a.filetype, a.file_hash, a.page, a.id, a.chunk_id, a.citation_index, a.preview_url) == ("body", "a.pdf", "application/pdf", "h1", 3, "c1", "c1", 2, "/sources/preview?collection=col&file_hash=h1")
    assert (b.text, b.filename, b.file_hash, b.row, b.n_rows, b.n_cols, b.style) == ("row text", "b.csv", "h2", 0, "9", "2", "postings")
    assert (c.text, c.filename, c.file_hash, c.chunk_id, c.id, c.n_rows) == ("A cat\n\nTags: cat, sofa", "img.png", "h3", "i1", "n2", None)
    assert (d.text, d.page, d.row) == ("inner", 7, 4) and (e.text, e.page, e.file_hash, e.posting_uuid) == ("", None, "h4", "u")
    assert (f.page, len(f.preview_text), f.filename) == (0, 280, None) and (g.text, h.text, h.filename) == ("", "", None)


def loop(sources, most, budget):
    shown = sources[:most]
    left, allow = budget, [0] * len(shown)
    for done, i in enumerate(sorted(range(len(shown)), key=lambda i: (len(shown[i]["text"] or ""), i))):
        allow[i] = min(len(shown[i]["text"] or ""), left // (len(shown) - done))
        left -= allow[i]
    out, cut = [], False

    def fit(text, n):
        nonlocal cut
        cut |= len(text) > n
        return text if len(text) <= n else f"{text[:n]}[... {len(text) - n} of {len(text)} characters not shown ...]"

    for i, s in enumerate(shown):
        parts = [f"Source {i + 1} [{s['filename'] or 'Unknown'} | page={'n/a' if s['page'] is None else s['page']} | row=n/a]:"]
        if s["network"]:
            parts.append(f"- Network: {s['network']}")
        if s["text"]:
            parts.append("Text: " + fit(s["text"], allow[i]))
        elif not s["network"]:
            parts.append(fit(json.dumps({k: s[k] for k in ("filename", "page", "text") if s[k] is not None}, separators=(",", ":")), allow[i] or budget))
        out.append("\n".join(parts))
    return "\n\n".join(out), cut


def test_texts_of_sources_share_a_budget(spark):
    r = random.Random(4)
    lists = {q: [{"filename": r.choice(["f.txt", "", None]), "page": r.choice([None, 0, 4]), "text": r.choice([None, "", "s" * r.randrange(9), "t" * r.randrange(200)]), "network": r.choice([None, "Net"])} for _ in range(r.randrange(1, 9))] for q in range(40)}
    rows = [(q, i, s["filename"], s["page"], None, s["text"], (s["network"], None)) for q, ss in lists.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "query_id int, position int, filename string, page int, row int, text string, reference struct<network: string, text: string>").repartition(3)
    for budget in (0, 50, 48_000):
        got = {x.query_id: (x.sources, x.truncated) for x in answers.sources_text(df, budget=budget).collect()}
        assert got == {q: loop(ss, 6, budget) for q, ss in lists.items()}


def test_findings_of_one_chunk_are_one_and_bundles_have_a_file_for_each_kind(spark, tmp_path):
    schema = "report_id string, position int, chunk_id string, filename string, page int, row int, chunk_text string, entity_label string, note string, entities array<string>, translation string"
    rows = [
        ("r", 1, "c1", "f", 1, None, "t", "Ada", "n1", ["a"], None), ("r", 2, "c2", "f", 1, None, "u", " ", None, None, None), ("r", 3, "c1", "f", 1, None, "t", " Bob ", "n2", ["b", "a"], "tr1"),
        ("r", 4, "c1", "f", 1, None, "t", "Ada", "n1", [], "tr2"), ("r", 5, None, "g", 2, None, "v", "X", None, ["x"], None), ("r", 6, " ", "g", 2, None, "v", "Y", "m", ["y"], None), ("s", 1, "c1", "f", 1, None, "t", "Ada", None, ["a"], None),
    ]
    got = state.merged_findings(spark.createDataFrame(rows, schema).repartition(3)).orderBy("report_id", "position").collect()
    assert [(x.report_id, x.position, x.labels, x.notes, list(x.entities), x.translation) for x in got] == [
        ("r", 1, "Ada · Bob", "n1 · n2", ["a", "b", "a"], "tr1"), ("r", 2, "", None, [], None), ("r", 5, "X · Y", "m", ["x", "y"], None), ("s", 1, "Ada", None, ["a"], None)]
    items = spark.createDataFrame([("chat", 2, "q2", "x"), ("chat", 1, "q,1", None), ("summary", 3, None, "text")], "kind string, position int, question string, summary string")
    columns = {"chat": ("question", "answer"), "summary": ("collection", "summary"), "entity": (), "hate_speech": ()}
    assert state.write_bundle(items, columns, str(tmp_path / "b")) == ["chat-answers", "summaries"]
    lines = [x for p in sorted((tmp_path / "b" / "chat-answers").glob("*.csv")) for x in p.read_text().splitlines()]
    assert [x for x in lines if x != "question,answer"] == ['"q,1",', "q2,"]
