"""The ten operators against brute force, round trips and odd rows."""

import collections
import hashlib
import json
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import avi, bpe, graphs, knn, lines, ngram_jaccard, packing, quality, textbytes, toxicity, url_lists, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some_docs(n=120, seed=1):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.randrange(30, 120))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append((i, " ".join(w), "en", "s", 1))
    odd = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, " \n\t ", "de", "s", 4), (903, "Two Words", "en", "s", 9), (904, "two  words", "en", "s", 10), (905, "x " * 20000, "en", "s", 40000), (906, "é ß " * 30, "fr", "s", 1)]
    return out + odd + [out[0]]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(spark, rows):
    """Extra columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, DOCS)
    for c in ("n_shingles", "score", "line", "piece", "sequence_id", "h1", "keep", "a", "first", "count", "rank", "part"):
        df = df.withColumn(c, F.lit("own"))
    return df


# -- line dedup


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def mutate(r, s, k):
    s = list(s)
    for _ in range(k):
        i = r.randrange(len(s) + 1)
        kind = r.randrange(3)
        if kind == 0:
            s.insert(i, r.choice("abcé"))
        elif s:
            i = min(i, len(s) - 1)
            s[i : i + 1] = [] if kind == 1 else [r.choice("abcé")]
    return "".join(s)


def test_banded_distances_are_edit_distances():
    r = random.Random(2)
    pairs = [("", ""), ("", "ab"), ("abc", "")]
    for _ in range(1500):
        a = "".join(r.choice("abé😀") for _ in range(r.randrange(50)))
        pairs.append((a, mutate(r, a, r.randrange(6))))
    got = lines.distances(*zip(*pairs))
    assert got.tolist() == [min(3, edit_distance(a, b)) for a, b in pairs]


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh é") for _ in range(r.randrange(5, 60))) for _ in range(50)]
    rows = [(i, "\n".join(mutate(r, r.choice(base), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randrange(8)))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "\n \n"), rows[5]]
    got = {x.doc_id: x for x in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for d, text in rows:
        for k, x in enumerate(text.split("\n") if text is not None else []):
            if len(x) >= lines.LEAST_EXACT and x.strip(" \t\n\r\x0b\x0c"):
                first[x] = min(first.get(x, (d, k)), (d, k))
    links = collections.Counter()
    names = [x for x in first if len(x) >= lines.LEAST_NEAR]
    for i, a in enumerate(names):
        for b in names[:i]:
            if abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2:
                links[max(a, b, key=first.get)] += 1
    for d, text in rows:
        exact, near = [], []
        for k, x in enumerate(text.split("\n") if text is not None else []):
            if x in links:
                near.append(k)
            elif x in first and first[x] != (d, k):
                exact.append(k)
        assert (list(got[d].exact_removed), list(got[d].near_removed)) == (exact, near)
    assert links and got[900].n_lines == 0 and got[901].n_lines == 1


def test_line_dedup_keeps_rows_and_columns(spark):
    rows = [(1, "a line that is long enough\nshort", "en", "s", 32), (2, "a line that is long enough\nother words in this line", "en", "s", 50), (3, None, None, None, None)]
    docs = clashing(spark, rows)
    out = {x.doc_id: x for x in lines.dedup(docs).collect()}
    assert lines.dedup(docs).columns == docs.columns
    assert (out[2].text, out[2].n_chars, out[2].line) == ("other words in this line", 24, "own")
    assert out[1].text == rows[0][1] and out[3].text is None
    assert lines.report(empty(spark)).count() == 0 and lines.dedup(empty(spark)).count() == 0


def test_long_runs_of_lines_that_share_a_segment(spark):
    rows = [(i, f"the same beginning of a line {i:04d} and an end") for i in range(60)]
    got = lines.report(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sum(edit_distance(a[1], b[1]) <= 2 for i, a in enumerate(rows) for b in rows[:i])
    assert sum(x.n_links for x in got.collect()) == want


@pytest.mark.parametrize("cell", [1024, 16])
def test_a_family_of_near_lines_counts_every_link_and_moves_few_rows(spark, cell, monkeypatch):
    monkeypatch.setattr(lines, "CELL", cell)
    r = random.Random(12)
    base = "a line that many documents hold, each of them in a form of its own"
    rows = list({mutate(r, base, r.choice([1, 1, 2])): i for i in range(150)}.items())
    docs = spark.createDataFrame([(i, t) for t, i in rows], "doc_id long, text string")
    want = collections.Counter(max(a[1], b[1]) for i, a in enumerate(rows) for b in rows[:i] if edit_distance(a[0], b[0]) <= 2)
    assert {x.doc_id: x.n_links for x in lines.report(docs).collect() if x.n_links} == want
    found = lines.meet(lines.probes(lines.versions(docs), 4, 20).repartitionById(4, F.col("bucket")))
    assert found.count() <= 12 * len(rows) < sum(want.values())


def test_line_dedup_of_repeated_ids_long_lines_and_emptied_documents(spark):
    long = "".join(random.Random(1).choice("abcdef ") for _ in range(300_000))
    rows = [(1, "a line that stands in two\nits own line here"), (1, "something else entirely\na line that stands in two"), (2, long), (3, long[:-1] + "x"), (None, "a line that stands in two"), (5, " \na line that stands in two\n"), (6, "short"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(x.doc_id, x.text) for x in lines.dedup(docs).collect()]
    assert len(out) == 8 and (5, " \n") in out and (3, "") in out and (None, rows[4][1]) in out
    assert sorted(x[1].count("two") for x in out if x[0] == 1) == [0, 1] and any("its own" in x[1] for x in out) and any("entirely" in x[1] for x in out)
    left = lines.dedup(docs, drop_emptied=True).collect()
    assert sorted(str(x.doc_id) for x in left) == ["1", "1", "2", "6", "7", "None"]
    assert lines.report(docs, least_exact=1, least_near=5).where("n_links > 0").count() == 1


# -- WARC


def test_links_of_scripts_and_of_hidden_parts():
    page = (
        "<a href=x>t</a><!-- <a href=no1> --><script src='a.js'>'<img src=no2>'</script><script>\"<a href=no3>\"</script><style>/*<img src=no4>*/</style>"
        "<noscript><img src=b></noscript><template><iframe src=\"c\"></iframe></template><svg><a href=d></a></svg><SCRIPT defer SRC=e></SCRIPT ><img src=q>"
    )
    meta, conv = warc.derive_one("k", warc.response(1, "http://h/", page, "1970-01-01T00:00:00Z"))
    links = json.loads(meta[14])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"]
    assert [(x["path"], x["url"]) for x in links] == [("a", "x"), ("script", "a.js"), ("img", "b"), ("iframe", "c"), ("a", "d"), ("script", "e"), ("img", "q")]
    assert meta[13] == conv[13] == 7 and conv[14] == "t"


def test_derivatives_refer_to_their_response(spark):
    page = "<html><head><title>A &amp; B</title><style>x{}</style></head><body><p>One <b>two</b></p><script>no()</script><a href='/x?a=1&amp;b=2'>three</a><table><tr><td>4</td><td>5</td></tr></table></body></html>"
    pages = spark.createDataFrame([(1, "http://h/ö", page, 0), (2, None, None, 0), (1, "http://h/ö", page, 0)], "page_id long, url string, html string, kind int")
    records = warc.responses(pages)
    raw = records.first().record
    headers, block = warc.parse(raw)
    out = warc.derive(records).collect()
    assert len(out) == 6 and all(x.digest_ok for x in out)
    meta, conv = (next(x for x in out if x.kind == k and x.record_key == "1") for k in ("metadata", "conversion"))
    assert [meta.refers_to] == [conv.refers_to] == headers["WARC-Record-ID"] != [conv.record_id]
    assert conv.source_payload_digest == headers["WARC-Payload-Digest"][0] == warc.sha1(page.encode())
    assert conv.block == "One two\nthree\n4 5" and meta.title == "A & B" and meta.n_links == 1 and '"/x?a=1&b=2"' in meta.block
    again, text = warc.parse(conv.record)
    assert text.decode() == conv.block and again["WARC-Refers-To"] == [conv.refers_to] and again["WARC-Block-Digest"] == [warc.sha1(text)] and again["WARC-Source-Payload-Digest"] == headers["WARC-Payload-Digest"]
    bad = spark.createDataFrame([("a", None), ("b", bytearray(b"junk")), ("c", bytearray(raw.replace(b"One", b"Two")))], "record_key string, record binary")
    assert [x.digest_ok for x in warc.derive(bad).collect()] == [False, False]
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_files_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(5)], "page_id long, url string, html string")
    records = warc.responses(pages)
    data = b"".join(bytes(r.member) for r in warc.gzip_members(records).collect())
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(b"".join(bytes(r.record) for r in records.collect()))
    got = warc.read_warc(spark, str(tmp_path))
    assert got.count() == 10
    assert sorted(x.block for x in warc.derive(got).where("kind = 'conversion'").collect()) == sorted([str(i) for i in range(5)] * 2)


def by_the_book(raw):
    """Header fields and payload of a response record, line by line."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = [x.split(": ", 1) for x in head.decode().split("\r\n")[1:]]
    http, _, payload = rest[: int(dict(fields)["Content-Length"])].partition(b"\r\n\r\n")
    return fields, [x.split(": ", 1) for x in http.decode().split("\r\n")[1:]], payload


def test_random_records_against_a_plain_parser(spark):
    r = random.Random(31)
    rows, want = [], {}
    for i in range(200):
        words = ["".join(r.choice("abcdé &") for _ in range(6)).strip() or "x" for _ in range(r.randrange(6))]
        charset = r.choice(["utf-8", "latin-1", "x-unknown", "hex", ""])
        payload = "<br>".join(w.replace("&", "&amp;") for w in words).encode("latin-1" if charset == "latin-1" else "utf-8")
        http = "\r\n".join(["HTTP/1.1 200 OK", f"Content-Type: text/html; charset={charset}", *(f"Set-Cookie: c{k}={r.randrange(9)}" for k in range(r.randrange(4))), "Server: s"]).encode() + b"\r\n\r\n" + payload
        head = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{i}>", "WARC-Target-URI: http://h/", *(["WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>"] if i % 2 else []), f"WARC-Payload-Digest: {warc.sha1(payload)}", f"Content-Length: {len(http)}"]
        raw = "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"
        rows.append((str(i), bytearray(raw)))
        lines = [" ".join(w.split()) for w in words]
        want[str(i)] = (*by_the_book(raw), "\n".join(x for x in lines if x))
    rows += [("bad", bytearray(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nx")), ("null", None)]
    records = spark.createDataFrame(rows, "record_key string, record binary").withColumn("kind", F.lit("own")).withColumn("title", F.lit(1))
    out = warc.derive(records).collect()
    assert len(out) == 400
    for x in out:
        fields, http, payload, text = want[x.record_key]
        for got, lines in ((x.source_headers, fields), (x[7], http)):
            assert {k: list(v) for k, v in got.items()} == {k: [b for a, b in lines if a == k] for k, _ in lines}
        assert x.source_payload_digest == warc.sha1(payload) and x.digest_ok and x.refers_to == f"<urn:uuid:{x.record_key}>"
        if x.kind == "conversion":
            assert x.block == text and f"WARC-Source-Payload-Digest: {warc.sha1(payload)}\r\n".encode() in bytes(x.record)
    long = warc.response(1, "http://h/", "<p>" + "word " * 400_000, "1970-01-01T00:00:00Z")
    assert len(warc.derive_one("k", long)[1][14]) == 5 * 400_000 - 1


def test_members_of_long_files(monkeypatch):
    import gzip

    records = [f"record {i} ".encode() * (i % 50) for i in range(300)]
    data = b"".join(gzip.compress(x) for x in records)
    for piece in (7, 1 << 16):
        monkeypatch.setattr(warc, "PIECE", piece)
        assert list(warc.members(data)) == records


# -- AVI


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4160, 9000])
def test_payloads_come_back_from_stored_files(n):
    raw = random.Random(n).randbytes(n)
    payload = avi.padded(raw)
    file = avi.store(payload)
    info = avi.read_avi(file)
    assert len(payload) % 64 == 0 and len(payload) > 0 and info["index"] == "idx1"
    assert avi.restore(file)[0] == payload
    cut = file[: file.index(b"idx1")]
    assert avi.read_avi(cut)["frames"] == info["frames"]  # without an index the chunks themselves are walked


def test_lossless_frames_need_no_special_table(monkeypatch):
    x = np.random.default_rng(1).integers(0, 256, (16, 64)).astype(np.uint8)
    j = avi.encode_frame(x)
    monkeypatch.setattr(avi, "OWN", {})
    assert (avi.decode_frame(j) == x).all()


def baseline(pixels, q=1):
    """A grey baseline JPEG by the book, for the decoder."""
    c = avi.basis()
    h, w = pixels.shape
    sizes = list(range(12))
    dc = avi.canonical([0, 0, 0, 12] + [0] * 12, sizes)
    pairs = [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    ac = avi.canonical([0] * 7 + [len(pairs)] + [0] * 8, pairs)
    bits = []

    def put(v, n):
        bits.extend(v >> i & 1 for i in range(n - 1, -1, -1))

    def value(v):
        n = abs(v).bit_length()
        put(v if v > 0 else v + (1 << n) - 1, n)

    before = 0
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            f = np.rint(c @ (pixels[y : y + 8, x : x + 8] - 128.0) @ c.T / q).astype(int).ravel()[avi.ZIGZAG]
            d = int(f[0]) - before
            before = int(f[0])
            put(*dc[abs(d).bit_length()])
            value(d)
            run, last = 0, max([k for k in range(1, 64) if f[k]], default=0)
            for k in range(1, last + 1):
                if not f[k]:
                    run += 1
                    continue
                while run > 15:
                    put(*ac[0xF0])
                    run -= 16
                put(*ac[run << 4 | abs(int(f[k])).bit_length()])
                value(int(f[k]))
                run = 0
            if last < 63:
                put(*ac[0])
    bits += [1] * (-len(bits) % 8)
    scan = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    s = avi.segment
    return b"".join((
        b"\xff\xd8", s(0xDB, bytes([0]) + bytes([q] * 64)), s(0xC0, struct.pack(">BHHB", 8, h, w, 1) + b"\x01\x11\x00"),
        s(0xC4, bytes([0x00, 0, 0, 0, 12, *[0] * 12, *sizes])), s(0xC4, bytes([0x10, *[0] * 7, len(pairs), *[0] * 8, *pairs])), s(0xDA, b"\x01\x01\x00\x00\x3f\x00"), scan, b"\xff\xd9",
    ))


def test_baseline_frames_and_shots(spark):
    r = np.random.default_rng(2)
    scenes = [np.clip(np.tile(np.linspace(a, a + 40, 32), (16, 1)), 0, 255) for a in (10, 200, 90)]
    frames = [np.clip(s + r.normal(0, 1, s.shape), 0, 255).astype(np.uint8) for s in scenes for _ in range(6)]
    coded = [baseline(f) for f in frames]
    assert all(np.abs(avi.decode_frame(j).astype(int) - f).max() <= 2 for j, f in zip(coded, frames))
    file = avi.write_avi(coded, 32, 16)
    files = spark.createDataFrame([(1, bytearray(file)), (2, None), (3, bytearray(b"no file"))], "doc_id long, media binary")
    got = [(x.doc_id, x.clip, x.start_frame, x.end_frame, x.start_s, x.end_s) for x in avi.clips(files).orderBy("clip").collect()]
    assert got == [(1, 0, 0, 6, 0.0, 0.24), (1, 1, 6, 12, 0.24, 0.48), (1, 2, 12, 18, 0.48, 0.72)]


def test_media_digests(spark):
    docs = clashing(spark, some_docs())
    out = avi.digests(docs).collect()
    texts = {d[0]: d[1] or "" for d in some_docs()}
    assert len(out) == len(some_docs())
    for x in out:
        p = avi.padded(texts[x.doc_id].encode())
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(texts[x.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    file = avi.media(docs.where("doc_id = 3")).first().media
    assert hashlib.sha256(file).hexdigest() == next(x.media_sha256 for x in out if x.doc_id == 3)
    assert avi.digests(empty(spark)).count() == 0


def test_features_list_every_clip():
    frames = ["0" if i // 13 % 2 else "z" for i in range(70 * 13)]
    a, b = "".join(x * 4096 for x in frames), "".join(x * 4096 for x in [*frames[:-13], frames[-14], *frames[-12:]])
    a, b = avi.digest(a), avi.digest(b)
    assert a[-1] == b[-1] == 70
    x, y = ([c for c in r[6].split(";")[1].removeprefix("clips=").split(",")] for r in (a, b))
    assert len(x) == len(y) == 70 and x[:68] == y[:68] and x[68:] != y[68:]


# -- packing


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    rows = some_docs() + [(950, "word " * 9000, "en", "s", 1), (951, "<|endoftext|> it's İΣ x\x1cy ½ 日本", "en", "s", 1)]
    out = packing.pack_documents(clashing(spark, rows), P.path("word_bpe_49k.json")).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for x in out:
        by_doc[x.doc_id].append(x)
        by_seq[x.sequence_id].append((x.offset, x.length))
    for d, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        want = [(i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes())) for i in range(0, len(ids), 4096)]
        assert sorted({(x.piece, x.start, x.length, x.ids_crc32) for x in by_doc[d]}) == want
        assert len(by_doc[d]) == len(want) * sum(r[0] == d for r in rows)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_seq) <= 1.02 * -(-sum(x.length for x in out) // 4096) + 1
    assert packing.pack_documents(empty(spark), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_rank_once(seed):
    r = random.Random(seed)
    counts = dict(collections.Counter(r.choice([r.randrange(1, 101), 100, 3, 50]) for _ in range(700)))
    plan = packing.Plan(counts, 100)
    lengths = np.repeat(list(counts), list(counts.values()))
    ranks = np.concatenate([np.arange(n) for n in counts.values()])
    seq, offset = plan(lengths, ranks)
    got = collections.defaultdict(list)
    for s, o, n in zip(seq, offset, lengths):
        got[s].append((o, n))
    for places in got.values():
        places.sort()
        assert [p[0] for p in places] == [0, *np.cumsum([p[1] for p in places])[:-1]] and sum(p[1] for p in places) <= 100
    free: list[int] = []  # one after the other, as the yardstick
    for n in sorted(lengths, reverse=True):
        fit = [i for i, f in enumerate(free) if f >= n]
        if fit:
            free[min(fit, key=lambda i: free[i])] -= n
        else:
            free.append(100 - n)
    assert len(got) <= len(free) + 2 + len(free) // 50


# -- top-k


@pytest.mark.parametrize("hot", [False, True])
def test_top_k_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 8)
    monkeypatch.setattr(knn, "ROW_BLOCK", 64)
    r = np.random.default_rng(4)
    x = r.normal(0, 0.2, (300, 6)) + r.normal(0, 1, (8, 6))[r.integers(0, 8, 300)]
    if hot:
        x[:120] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(800, None), (801, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (802, [float("nan")] * 6), (803, [float("inf")] * 6), (804, []), (805, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1))
    v = df.select("vec_id", knn.scaled(F.col("embedding")).alias("v"))
    got = knn.top_k(v, v.where("vec_id % 10 = 0"), k=7, pivots=9).orderBy("query_id", "rank").collect()
    z = {i: np.floor(1024 * np.array(e + [0.0] * (6 - len(e)))).astype(int) for i, e in rows if e and None not in e and np.isfinite(e).all()}
    want = []
    for q in sorted(i for i in z if i % 10 == 0):
        best = sorted((-int(z[q] @ z[i]), i) for i in z if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert [tuple(g) for g in got] == want
    assert knn.top_k(v.limit(0), v).count() == 0 and knn.top_k(v, v.limit(0)).count() == 0
    assert knn.top_k(v.where("vec_id < 3"), v.where("vec_id = 0")).count() == 2


@pytest.mark.parametrize("rows", [[1], [5, 1, 1, 40, 3, 9], [100, 1], [10, 10, 10], [1] * 50, [7, 93, 1000, 2]])
def test_slots_are_bounded_and_hold_every_cell(rows):
    first, n = knn.slots(np.array(rows), 10)
    held: dict[int, float] = {}
    for r, f, m in zip(rows, first, n):
        assert m >= 1 and r / m <= 10
        for s in range(f, f + m):
            held[s] = held.get(s, 0) + r / m
    assert max(held.values()) <= 20 and len(held) <= sum(rows) // 10 + 1


# -- classifiers


def labelled(spark, n=900):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        lang = r.choice(["en", "de"])
        w = [r.choice(toxicity.FUNCTION_WORDS[lang].split()) if r.random() < 0.4 else "".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(r.randrange(20, 80))]
        toxic, good = r.random() < 0.25, r.random() < 0.8
        if toxic:
            for _ in range(2):
                w[r.randrange(len(w))] = {"en": "vilename", "de": "wustwort" + r.choice("abcdef")}[lang]
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_documents_that_were_held_out(spark):
    docs, labels = labelled(spark)
    net = toxicity.train(docs, labels)
    out = toxicity.score(docs, net).join(labels, "doc_id").where("held_out").toPandas()
    assert ((out.score >= 0.7).astype(int) == out.predicted).all() and out.score.between(0, 1).all()
    assert (out.predicted == out.toxic).mean() > 0.95
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) for i in out.doc_id)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs, toxicity.train(docs, flipped)).orderBy("doc_id").toPandas()
    assert (again.score.to_numpy() == toxicity.score(docs, net).orderBy("doc_id").toPandas().score.to_numpy()).all()
    odd = toxicity.score(clashing(spark, some_docs()), net)
    assert odd.count() == len(some_docs()) and odd.where("score is null or isnan(score)").count() == 0
    assert toxicity.score(empty(spark), net).count() == 0
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0)))
    assert none.where("predicted = 1").count() == 0


def test_languages_are_told_by_function_words():
    _, whole, at = toxicity.word_ids(pa.array(["the house of the king", "der Hund und die Katze", "xyz", "", "le chat dans la maison et"]))
    assert [toxicity.LANGUAGES[i] for i in toxicity.languages(whole, at)] == ["en", "de", "other", "other", "fr"]


def test_quality_views_and_odd_rows(spark):
    docs, labels = labelled(spark)
    hidden = labels.where("doc_id % 3 <> 0")
    out = quality.score(docs, hidden).join(labels, "doc_id").where("doc_id % 3 = 0").toPandas()
    assert (out.keep.astype(int) == out.quality).mean() > 0.97
    rows = clashing(spark, some_docs())
    scored = quality.score(rows, hidden)
    assert scored.count() == len(some_docs()) and scored.where("score is null or isnan(score)").count() == 0
    assert quality.score(rows, hidden.limit(0)).where("keep").count() == len(some_docs())
    assert quality.score(empty(spark), hidden).count() == 0
    assert quality.keep_good(rows, hidden).columns == rows.columns


# -- n-gram Jaccard


def brute_components(rows):
    sets = {}
    for d, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("short_run", [24, 2])
def test_components_equal_brute_force(spark, short_run, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SHORT_RUN", short_run)
    rows = some_docs()
    got = ngram_jaccard.classes(clashing(spark, rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows) and {(x.doc_id, x.n_shingles, x.component_id) for x in got} == {(d, n, c) for d, (n, c) in want.items()}
    assert any(c != d for d, (_, c) in want.items())


def test_a_large_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([0, 1, 2])):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, "a common line that all documents of this table have " + " ".join(w) if i % 3 else "a common line that all documents of this table have " + " ".join(f"y{r.randrange(10**6)}" for _ in range(60)), "en", "s", 1))
    got = ngram_jaccard.classes(spark.createDataFrame(rows, DOCS)).collect()
    want = brute_components(rows)
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == {(d, n, c) for d, (n, c) in want.items()}


@pytest.mark.parametrize("cell", [1024, 7])
def test_a_family_with_many_members_that_nearly_link(spark, cell, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "CELL", cell)
    monkeypatch.setattr(ngram_jaccard, "SHORT_RUN", 6)
    r = random.Random(19)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6])):
            w[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    got = ngram_jaccard.classes(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    want = brute_components(rows)
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == {(d, n, c) for d, (n, c) in want.items()}
    assert 30 < len({c for _, c in want.values()}) < 230


def test_rows_without_or_with_a_repeated_doc_id(spark):
    texts = {1: "one two three four five six seven", 2: "one two three four five six seven", 3: "b " * 9, 4: "other words in this text are here"}
    rows = [(i, t, None, None, None) for i, t in texts.items()] + [(None, texts[1], None, None, None), (None, None, None, None, None), (3, "a text that comes first and counts for three", None, None, None), (4, None, None, None, None), (9, "a text that comes first and counts for three", None, None, None)]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in ngram_jaccard.classes(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, 3, 1), (2, 3, 1), (3, 5, 3), (3, 5, 3), (9, 5, 3), (4, 3, 4), (4, 3, 4), (None, 3, None), (None, 0, None)], key=str)
    left = ngram_jaccard.dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((x.doc_id, x.text) for x in left), key=str) == sorted([(1, texts[1]), (3, rows[6][1]), (4, texts[4]), (None, texts[1]), (None, None)], key=str)


def test_dedup_keeps_one_of_each_group(spark):
    rows = some_docs()
    want = brute_components(rows)
    docs = clashing(spark, rows)
    out = ngram_jaccard.dedup(docs)
    assert out.columns == docs.columns
    assert sorted(x.doc_id for x in out.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    assert ngram_jaccard.dedup(empty(spark)).count() == 0 and ngram_jaccard.classes(empty(spark)).count() == 0


def test_connected_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + r.randrange(50), 200 + r.randrange(50)) for _ in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {x.v: x.c for x in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {v: v for e in edges for v in e}
    for _ in range(100):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


# -- URL lists


def test_list_entries_hold_from_their_date_to_the_next(spark):
    e = spark.createDataFrame(
        [("l", "Bad.org", "block", 1.0, "2024-01-10"), ("l", "bad.org", "remove", 1.0, "2024-03-05"), ("l", "bad.org", "block", 1.0, "2024-06-01"), ("m", "ok.bad.org", "allow", 1.0, "2024-01-01"), ("l", "x.net", "block", 1.0, "2024-01-01"), ("l", "x.net", "allow", 2.0, "2024-01-01"), (None, "y.net", "block", 1.0, "2024-01-01"), ("l", "z.net", "block", None, None)],
        "list_name string, key string, action string, weight double, effective string",
    ).withColumn("effective", F.col("effective").cast("timestamp"))
    rows = [(1, "http://www.bad.org/a", "2024-01-09"), (2, "http://www.bad.org/a", "2024-01-10"), (3, "https://u@BAD.org.:80/", "2024-03-04"), (4, "http://bad.org", "2024-03-05"), (5, "http://bad.org", "2025-01-01"), (6, "http://ok.bad.org/", "2024-02-01"), (7, None, "2024-02-01"), (8, "junk", "2024-02-01"), (9, "http://x.net/", "2024-01-02"), (10, "http://bad.org", None), (2, "http://www.bad.org/a", "2024-01-10"), (11, "http://notbad.org", "2024-02-01")]
    c = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp"))
    for name in ("host", "key", "month", "lists", "valid_from", "action"):
        c = c.withColumn(name, F.lit("own"))
    got = {x.page_id: (x.decision, x.lists) for x in url_lists.as_of(c, e).collect()}
    assert got == {1: ("keep", ""), 2: ("drop", "l"), 3: ("drop", "l"), 4: ("keep", ""), 5: ("drop", "l"), 6: ("keep", "l,m"), 7: ("keep", ""), 8: ("keep", ""), 9: ("drop", "l"), 10: ("keep", ""), 11: ("keep", "")}
    assert url_lists.as_of(c.limit(0), e).count() == 0 and url_lists.as_of(c, e.limit(0)).where("blocked").count() == 0


# -- BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_encoding_equals_tiktoken(codec):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(8)
    texts = ["", " ", "a" * 3000, " " * 500 + "x", "ab" * 1500, "x\x1cy\x85z  w ", "<|endoftext|> it's", "日本語" * 50, "퟿", "don't  stop\n\n now\t"]
    texts += ["".join(r.choice("abcdetinghorsaou ößéñ'0123\n\t 日本😀") for _ in range(r.randrange(60))) for _ in range(4000)]
    for x in texts:
        ids = codec.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(x)
        assert codec.decode(ids) == x.encode()


def test_stepping_back_gives_the_same(codec):
    r = random.Random(10)
    for _ in range(1500):
        b = bytes(r.choice(b"abcdeinost ") for _ in range(r.randrange(1, 30)))
        assert codec.step_back(b.decode("latin-1")) == [codec.ranks[t] for t in codec.merged(b, 1)]


def test_bpe_tables(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = clashing(spark, some_docs())
    coded = bpe.encode(docs, path, P.PATTERN)
    back = {x.doc_id: bytes(x.text) for x in bpe.decode(coded, path, P.PATTERN).collect()}
    assert back == {d[0]: (d[1] or "").encode() for d in some_docs()}
    ids = {x.doc_id: bytes(x.ids) for x in coded.collect()}
    out = bpe.digests(docs, path, P.PATTERN).collect()
    assert len(out) == len(some_docs())
    for x in out:
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids[x.doc_id]) // 4, hashlib.sha256(ids[x.doc_id]).hexdigest(), hashlib.sha256(back[x.doc_id]).hexdigest())
    assert bpe.digests(empty(spark), path, P.PATTERN).count() == 0


# -- shared helpers


def test_words_and_shingles_do_not_cross_rows():
    col = pa.array(["One two three four five six", None, "", "one TWO three four five", "one two", "six seven"])
    sets = textbytes.shingles(col)
    assert [len(s) for s in sets] == [2, 0, 0, 1, 1, 1]
    assert sets[3][0] in sets[0]
    assert [len(s) for s in textbytes.shingles(col.slice(3, 2))] == [1, 1] and textbytes.shingles(col.slice(3, 2))[0][0] == sets[3][0]
    parts = [b.num_rows for b in textbytes.blocks(pa.RecordBatch.from_arrays([col], names=["text"]), "text", 10)]
    assert sum(parts) == 6


def test_modules_of_the_rest_do_not_import_this_package():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "lodestrata"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M)
