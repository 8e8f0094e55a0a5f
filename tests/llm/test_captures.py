"""WARC captures as crawls have them: codings, digests, other types, pages that leave everything open; frames without tables."""

import base64
import gzip
import hashlib
import json
import random
import time
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lodestrata.llm import avi, quality, toxicity, warc

PAGE = "<html><title>A &amp; B</title><p>One</p><a href='http://x/?a=1&amp;b'>two</a></html>"


def capture(body: bytes, http: list[str], digest: str | None = None, block_digest: str | None = None) -> bytes:
    """Written by hand, not by the operator."""
    block = "\r\n".join(["HTTP/1.1 200 OK", *http]).encode() + b"\r\n\r\n" + body
    head = ["WARC/1.0", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:1>", "WARC-Target-URI: http://h/", f"Content-Length: {len(block)}"]
    head += [f"WARC-Payload-Digest: {digest}"] if digest else []
    head += [f"WARC-Block-Digest: {block_digest}"] if block_digest else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def chunks(body: bytes, r: random.Random) -> bytes:
    out, at = b"", 0
    while at < len(body):
        n = r.randrange(1, 9)
        part = body[at : at + n]
        out += f"{len(part):x}{r.choice(['', ';ext=1'])}\r\n".encode() + part + b"\r\n"
        at += n
    return out + b"0\r\nTrailer: x\r\n\r\n"


def raw_deflate(data: bytes) -> bytes:
    z = zlib.compressobj(wbits=-15)
    return z.compress(data) + z.flush()


CODINGS = {"gzip": gzip.compress, "x-gzip": lambda d: gzip.compress(d[:9]) + gzip.compress(d[9:]), "deflate": zlib.compress, "Deflate": raw_deflate, "zstd": zstandard.compress, "identity": lambda d: d}


@pytest.mark.parametrize("coding", CODINGS)
@pytest.mark.parametrize("chunked", [False, True])
def test_codings_are_undone(coding, chunked):
    body = CODINGS[coding](PAGE.encode())
    sent = chunks(body, random.Random(1)) if chunked else body
    fields = ["Content-Type: text/html", f"Content-Encoding: {coding}", *(["Transfer-Encoding: chunked"] if chunked else [])]
    for data in (sent, body):  # digests of either form are found in crawls
        meta, conv = warc.derive_one("k", capture(sent, fields, "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()))
        assert conv[14] == "One\ntwo" and (meta[12], meta[13], meta[9]) == ("A & B", 1, True)
    assert json.loads(meta[14])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"] == [{"path": "a", "url": "http://x/?a=1&b"}]
    # archives that have undone a coding and kept its field
    assert warc.derive_one("k", capture(PAGE.encode(), ["Content-Encoding: gzip", "Transfer-Encoding: chunked"]))[1][14] == "One\ntwo"


def test_payloads_that_cannot_be_read_or_are_no_text(monkeypatch):
    gz = gzip.compress(PAGE.encode())
    for body, fields, problem in (
        (gz[:20], ["Content-Encoding: gzip"], "cut short"), (b"\x1f\x8bxx", ["Content-Encoding: gzip"], "gzip"), (b"x", ["Content-Encoding: br"], "content coding br"), (b"x", ["Content-Encoding: zstd"], "zstd"),
    ):
        (meta,) = warc.derive_one("k", capture(body, ["Content-Type: text/html", *fields]))
        assert meta[1] == "metadata" and problem in meta[17] and problem in json.loads(meta[14])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["Entity-Problem"]
    monkeypatch.setattr(warc, "MOST_BYTES", 50)
    assert "too large" in warc.derive_one("k", capture(gzip.compress(b"a" * 5000), ["Content-Encoding: gzip"]))[0][17]
    (meta,) = warc.derive_one("k", capture(b"\x89PNG", ["Content-Type: image/png"]))
    assert (meta[16], meta[17], meta[12]) == ("image/png", None, None)
    assert warc.derive_one("k", capture(b"a <b> & c", ["Content-Type: text/plain"]))[1][14] == "a <b> & c"
    assert warc.derive_one("k", capture(b'{"a": 1}', ["Content-Type: application/ld+json; charset=utf-8"]))[1][14] == '{"a": 1}'


def test_digests_of_several_algorithms():
    body = PAGE.encode()
    for name in ("sha1", "sha256", "sha512", "md5"):
        raw = hashlib.new(name, body).digest()
        for value in (raw.hex(), raw.hex().upper(), base64.b32encode(raw).decode(), base64.b32encode(raw).decode().rstrip("=")):
            assert warc.derive_one("k", capture(body, [], f"{name}:{value}"))[0][9]
        assert not warc.derive_one("k", capture(body, [], f"{name}:{'00' * len(raw)}"))[0][9]
    assert warc.derive_one("k", capture(body, [], "SHA-256:" + hashlib.sha256(body).hexdigest()))[0][9]
    assert warc.derive_one("k", capture(body, [], "blake9:xyz"))[0][9]
    assert not warc.derive_one("k", capture(body, [], None, "sha1:AAAA"))[0][9]


OPEN = ["<a ", "<script>", "<svg>", "<title>", '<a "', '<a ">', "<a '\">", "<!--", "<", "</", "<?", "<a href=", "<noscript>", '<a href="x']


@pytest.mark.parametrize("end", ["", '">', "</noscript></svg>", "-->", "'"])
def test_a_megabyte_that_leaves_everything_open_is_scanned_in_a_moment(end):
    for s in OPEN:
        began = time.process_time()
        warc.Page(s * (1_000_000 // len(s)) + end).text()
        assert time.process_time() - began < 8, s  # quadratic scans took minutes


def test_pages_are_scanned_as_they_read():
    p = warc.Page("<TITLE>T &lt;1</TITLE ><p>a<b>c</b>&nbsp;d<!-- no > --><script src=s.js>if (a<b) '</p>'</script >1 < 2<br/>x > y<svg><a href=in>hidden</a></svg><td>1</td><td>2<img alt='>' src=\"i\"><a data-href=no href = 'yes'>z <![CDATA[q]]> e")
    assert p.title == "T <1" and p.text() == "ac d 1 < 2\nx > y 1 2z e"
    assert [(x["path"], x["url"]) for x in p.links] == [("script", "s.js"), ("a", "in"), ("img", "i"), ("a", "yes")]
    assert warc.Page("").text() == "" and warc.Page("<").text() == "<" and warc.Page("a <b").text() == "a <b" and warc.Page("<script>a<p>b").text() == "a\nb"


# -- motion JPEG without tables of its own


def test_frames_without_huffman_tables_mean_the_standard_ones(spark):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(48, 40, jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
    r = np.random.default_rng(3)
    want = np.clip(np.add.outer(np.arange(40) * 3, np.arange(48) * 2) + r.integers(0, 60, (40, 48)), 0, 255).astype(np.uint8)
    for y in range(40):
        for x in range(48):
            image.getRaster().setSample(x, y, 0, int(want[y, x]))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    whole = bytes(out.toByteArray())
    at, bare = 2, whole[:2]
    while whole[at + 1] != 0xDA:
        size = 2 + int.from_bytes(whole[at + 2 : at + 4])
        bare += b"" if whole[at + 1] == 0xC4 else whole[at : at + size]
        at += size
    bare += whole[at:]
    assert len(bare) < len(whole) - 150
    frame = avi.decode_frame(bare)
    assert (frame == avi.decode_frame(whole)).all() and np.abs(frame.astype(int) - want).mean() < 12
    files = spark.createDataFrame([(1, avi.write_avi([bare] * 3, 48, 40)), (2, None), (3, b"broken"), (4, avi.write_avi([b"\xff\xd8\xff"], 8, 8)), (5, avi.store(b"x" * 64))], "doc_id long, media binary")
    assert {x.doc_id for x in avi.clips(files).collect()} == {1, 5}
    problems = {x.doc_id: x.problem for x in avi.problems(files).collect()}
    assert set(problems) == {2, 3, 4} and problems[2] == "no file" and problems[3] == "no frame"


def test_shots_by_plain_loops():
    r = np.random.default_rng(5)
    frames = [np.clip(r.normal(m, 20, (16, 16)), 0, 255).astype(np.uint8) for m in [60] * 20 + [200] * 9 + [90] * 15]
    d = avi.differences(frames)
    for i, f in enumerate(frames):
        hist = [[sum(int(v) // (256 // avi.BINS) == b for v in g.ravel()) / g.size for b in range(avi.BINS)] for g in (frames[i - 1], f)]
        assert abs(d[i] - (sum(abs(a - b) for a, b in zip(*hist)) / 2 if i else 0)) < 1e-9
    cuts = []
    for i in range(1, len(d)):
        near = [d[j] for j in range(max(1, i - 12), min(len(d), i + 13)) if j != i]
        mean = sum(near) / len(near)
        deviation = (sum((x - mean) ** 2 for x in near) / len(near)) ** 0.5
        if d[i] > 0.08 and d[i] > mean + 3 * deviation:
            cuts.append(i)
    assert [s[0] for s in avi.shots(d)[1:]] == cuts == [20, 29]


# -- filters judge rows


def test_a_row_goes_by_itself_where_ids_repeat(spark, monkeypatch):
    r = random.Random(1)
    word = lambda bad: r.choice(["awful", "idiot", "hate"] if bad and r.random() < 0.5 else ["calm", "river", "stone", "house", "green"])
    rows = [(i, " ".join(word(i % 4 == 0) for _ in range(40)), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows + [(0, rows[1][1], "en", "s"), (1, rows[0][1], "en", "s"), (None, rows[0][1], "en", "s"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("__n", F.lit("own"))
    net = toxicity.train(docs, labels)
    texts = {x.doc_id: x.text for x in docs.where("doc_id > 1").collect()}
    alone = {texts[x.doc_id]: x.score for x in toxicity.score(docs.where("doc_id > 1"), net).collect()}
    alone |= dict(zip((rows[0][1], rows[1][1]), (x.score for x in toxicity.score(spark.createDataFrame(rows[:2], "doc_id long, text string, lang string, source string").coalesce(1), net).orderBy("doc_id").collect())))
    monkeypatch.setattr(toxicity, "PREDICTED_FROM", (alone[rows[0][1]] + alone[rows[1][1]]) / 2)  # between the two
    stays = {x: s < toxicity.PREDICTED_FROM for x, s in alone.items()}
    got = sorted(((x.doc_id, x.text) for x in toxicity.keep_clean(docs, labels).collect()), key=str)
    assert got == sorted(((x.doc_id, x.text) for x in docs.collect() if x.doc_id is None or stays[x.text]), key=str)
    assert stays[rows[0][1]] != stays[rows[1][1]] and len([1 for i, _ in got if i in (0, 1)]) == 2
    views = docs.drop("__n")
    good = {(x.doc_id, x.text) for x in quality.keep_good(views, labels).collect()}
    kept = {(x.doc_id, x.keep) for x in quality.score(views, labels).collect()}
    assert (None, None) in good and all(((i, t) in good) for i, t, *_ in rows if (i, False) not in kept and i > 1)
    assert quality.keep_good(views, labels).columns == views.columns
