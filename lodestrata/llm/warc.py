"""WARC derivatives: a metadata record and a plain-text conversion record for each response record.

Derived records refer to their response by WARC-Refers-To and keep its target, date and digests; the
metadata record's JSON holds all headers of the source record and of the HTTP message. Digests are
checked against the bytes. Every record is made from one input row, so that nothing is shuffled.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import html as htmllib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidied

CRLF = b"\r\n"
PIECE = 1 << 16  #: bytes of a compressed file at a time
DERIVED = (
    "record_key string, kind string, record_id string, refers_to string, target_uri string, warc_date string, "
    "source_headers map<string,array<string>>, http_headers map<string,array<string>>, source_payload_digest string, digest_ok boolean, "
    "block_digest string, content_length long, title string, n_links int, block string, record binary, mime string, problem string"
)
BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article nav header footer title blockquote pre hr dd dt dl form option".split())
CELLS = frozenset(("td", "th"))
HIDDEN = frozenset(("noscript", "template", "svg"))  #: no text, but links
RAW = frozenset(("script", "style"))  #: neither
LINKS = frozenset(("a", "link", "img", "script", "iframe"))
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
QUOTED_OR_END = re.compile(r"[>\"']")
CLOSING = {x: re.compile(rf"</{x}\s*>", re.I) for x in (*HIDDEN, *RAW, "title")}
URL = re.compile(r"[\s\"'/](?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HTML = frozenset(("text/html", "application/xhtml+xml"))
TEXTS = re.compile(r"text/|application/(?:[\w.+-]+\+)?(?:xml|json|javascript)$|application/(?:x-ndjson|rss|atom)")
MOST_BYTES = 1 << 28  #: of a payload once it is unpacked
BLANKS = re.compile(r"[ \t\r\f\v ]+")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*names: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(str, names)))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return CRLF.join([b"WARC/1.1", *(x.encode() for x in lines), b"", block, b"", b""])


def response(key: object, url: str | None, body: str | None, date: str) -> bytes:
    """The response record of a page; a null url is about:blank, a null body is empty."""
    payload = (body or "").encode()
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode(), b"", payload])
    target = re.sub(r"[\r\n]+", " ", url or "about:blank")
    return record(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", urn("response", key, target)), ("WARC-Date", date), ("WARC-Target-URI", target),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(http)),
        ],
        http,
    )


def header_lines(raw: bytes) -> list[tuple[str, str]]:
    """Header fields; a line that begins with a blank goes on with the field before."""
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def grouped(lines: list[tuple[str, str]]) -> dict[str, list[str]]:
    """The values of each field, in order, under its name as first written."""
    out: dict[str, list[str]] = {}
    names: dict[str, str] = {}
    for k, v in lines:
        out.setdefault(names.setdefault(k.lower(), k), []).append(v)
    return out


def parse(raw: bytes) -> tuple[dict[str, list[str]], bytes]:
    """Headers, each with all its values, and block of one record. ValueError for anything else, as for a Content-Length that is no number."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = grouped(header_lines(head))
    return headers, rest[: int(field(headers, "Content-Length") or len(rest))]


def field(headers: dict[str, list[str]], name: str) -> str | None:
    """The first value of a field."""
    return next((v[0] for k, v in headers.items() if k.lower() == name.lower()), None)


def decoded(payload: bytes, content_type: str) -> str:
    """The page by the charset that its header names; without one, or with an unknown one, as UTF-8. Bad bytes are replaced."""
    named = re.findall(r"charset=[\"']?([\w.:-]+)", content_type)
    try:
        return payload.decode(named[0].lower() if named else "utf-8", "replace")
    except (LookupError, UnicodeError):  # UnicodeError: of codecs that aren't for text
        return payload.decode("utf-8", "replace")


def as_json(headers: dict[str, list[str]]) -> dict[str, str | list[str]]:
    return {k: v[0] if len(v) == 1 else v for k, v in headers.items()}


class Page:
    """Text, title and links of a page, by one scan of its tags from left to right.

    What was looked for once and isn't there is not looked for again, so that the time goes with the length, whatever is left open.
    A tag ends at the first > outside its quotes; without one, < is text.
    """

    def __init__(self, page: str):
        self.page, self.parts, self.links, self.title = page, [], [], None
        self.absent: set[str] = set()
        self.closed: dict[str, re.Match | None] = {}
        self.special, self.looked_from, self.bad = -1, 0, set()
        self.last = {q: page.rfind(q) for q in ">\"'"}
        self.scan()

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def closing(self, name: str, at: int) -> re.Match | None:
        found = self.closed.get(name)
        if name not in self.absent and (found is None or found.start() < at):
            found = self.closed[name] = CLOSING[name].search(self.page, at)
            if found is None:
                self.absent.add(name)
        return found if name not in self.absent else None

    def tag_end(self, at: int) -> int:
        """Behind the > that ends the tag at ``at``; -1 if none does."""
        if not self.looked_from <= at <= self.special:
            found = QUOTED_OR_END.search(self.page, at)
            self.looked_from, self.special = at, found.start() if found else len(self.page)
        place = first = self.special
        while place not in self.bad:
            if place >= len(self.page) or place > self.last[">"]:
                break
            char = self.page[place]
            if char == ">":
                return place + 1
            if self.last[char] <= place:
                break
            found = QUOTED_OR_END.search(self.page, self.page.index(char, place + 1) + 1)
            place = found.start() if found else len(self.page)
        self.bad |= {first, place}
        return -1

    def scan(self) -> None:
        page, at, hidden = self.page, 0, -1
        say = lambda x: self.parts.append(x) if at >= hidden else None
        while True:
            lt = page.find("<", at)
            if lt < 0:
                say(page[at:])
                return
            say(page[at:lt])
            at = lt
            kind = page[lt + 1 : lt + 2]
            if kind in ("!", "?"):
                end = self.find("-->", lt + 4) + 2 if page.startswith("<!--", lt) else 1
                end = end if end > 1 else self.find(">", lt)
                say(" " if end > 0 else "<")
                at = end + 1 if end > 0 else lt + 1
                continue
            end = self.tag_end(lt + 2) if kind == "/" or kind.isascii() and kind.isalpha() else -1
            if end < 0:
                say("<")
                at = lt + 1
                continue
            found = NAME.match(page, lt + 1, end)
            name = found[1].lower() if found else ""
            if kind != "/" and name in LINKS and (m := URL.search(page, found.end(), end)):
                self.links.append({"path": name, "url": htmllib.unescape(m[1] or m[2] or m[3] or "")})
            close = self.closing(name, end) if kind != "/" and name in CLOSING else None
            if close and name == "title":
                if self.title is None:
                    self.title = BLANKS.sub(" ", htmllib.unescape(Page(page[end : close.start()]).text_with_breaks())).strip()
                say(" ")
                at = close.end()
            elif close and name in RAW:
                say(" ")
                at = close.end()
            else:
                if close:
                    say(" ")
                    hidden = max(hidden, close.end())
                elif name in BREAKS:
                    say("\n")
                elif name in CELLS:
                    say("\t")
                at = end

    def text_with_breaks(self) -> str:
        return "".join(self.parts)

    def text(self) -> str:
        """What a reader sees, one line for each block of the page, without empty lines."""
        lines = (BLANKS.sub(" ", x).strip() for x in htmllib.unescape(self.text_with_breaks()).split("\n"))
        return "\n".join(x for x in lines if x)


def plain_text(page: str) -> str:
    return Page(page).text()


def dechunked(body: bytes) -> bytes:
    """A body sent in chunks, as one; ValueError if the chunks' sizes don't fit."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        if size < 0 or end + 2 + size > len(body):
            raise ValueError("chunks cut short")
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def inflated(body: bytes, coding: str) -> bytes:
    """A body without one content coding. ValueError for unknown ones, broken data, and more than MOST_BYTES."""
    if coding in ("identity", ""):
        return body
    if coding == "zstd":
        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError as e:
            raise ValueError(f"zstd: {e}") from e
    if coding not in ("gzip", "x-gzip", "deflate"):
        raise ValueError(f"content coding {coding}")
    bits = 31 if coding != "deflate" else 15 if body[:1] and body[0] & 15 == 8 and int.from_bytes(body[:2]) % 31 == 0 else -15
    out, left = [], MOST_BYTES
    while body:
        z = zlib.decompressobj(bits)
        try:
            out.append(z.decompress(body, left))
        except zlib.error as e:
            raise ValueError(f"{coding}: {e}") from e
        left -= len(out[-1])
        if not z.eof:
            raise ValueError(f"{coding}: " + ("too large" if left <= 0 else "cut short"))
        body = z.unused_data if bits == 31 and z.unused_data[:2] == b"\x1f\x8b" else b""
    return b"".join(out)


def digest_is(given: str, *data: bytes) -> bool | None:
    """Whether a digest (name:base32 or hex) is that of one of the data; null for algorithms that aren't known."""
    name, _, value = given.strip().partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5", "sha224", "sha384"):
        return None
    value = value.strip()
    for d in data:
        raw = hashlib.new(name, d).digest()
        if value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("="):
            return True
    return False


def unpacked(payload: bytes, http: dict[str, list[str]]) -> tuple[bytes, bytes, str | None]:
    """(body without transfer coding, body without content codings, why that failed). A body that says it comes in chunks and
    doesn't is taken as it is, since archives often undo this coding and keep the field."""
    body, coded = payload, [x.strip().lower() for v in values(http, "Transfer-Encoding") for x in v.split(",")]
    if "chunked" in coded:
        with contextlib.suppress(ValueError):
            body = dechunked(payload)
    plain, codings = body, [x.strip().lower() for v in values(http, "Content-Encoding") for x in v.split(",")]
    try:
        for coding in reversed(codings):
            if coding in ("gzip", "x-gzip") and plain[:2] != b"\x1f\x8b":
                continue  # undone by the archive
            plain = inflated(plain, coding)
    except ValueError as e:
        return body, b"", str(e)
    return body, plain, None


def values(headers: dict[str, list[str]], name: str) -> list[str]:
    return next((v for k, v in headers.items() if k.lower() == name.lower()), [])


def derive_one(key: str, raw: bytes) -> list[tuple]:
    """The metadata record of one response record, and the conversion record if its payload is text; other kinds of record have none."""
    headers, block = parse(raw)
    if field(headers, "WARC-Type") != "response":
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    http = grouped(header_lines(head))
    source = field(headers, "WARC-Payload-Digest")
    body, plain, problem = unpacked(payload, http)
    given = field(headers, "WARC-Block-Digest")
    checks = [digest_is(source, payload, body) if source else None, digest_is(given, block) if given else None]
    named = field(http, "Content-Type") or ""
    mime = named.split(";")[0].strip().lower()
    is_html = mime in HTML or not mime
    is_text = is_html or bool(TEXTS.match(mime))
    page, title, links, text = "", None, [], ""
    if is_text and not problem:
        page = decoded(plain, named)
    if is_html and page:
        scanned = Page(page)
        title, links, text = scanned.title, scanned.links, scanned.text()
    elif is_text:
        text = page
    source_id, target, date = (field(headers, n) for n in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    message = {"Response-Message": head.split(b"\r\n")[0].decode("utf-8", "replace"), "Headers": as_json(http)}
    message |= {"HTML-Metadata": {"Title": title, "Links": links}} if is_html else {}
    message |= {"Entity-Problem": problem} if problem else {}
    info = {"Envelope": {"WARC-Header-Metadata": as_json(headers), "Payload-Metadata": {"HTTP-Response-Metadata": message}}}
    out = []
    records = [("metadata", json.dumps(info, ensure_ascii=False), "application/json")]
    records += [("conversion", text, "text/plain")] if is_text and not problem else []
    for kind, content, made in records:
        data = content.encode("utf-8", "surrogatepass")
        own = urn(kind, source_id)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source_id), ("WARC-Target-URI", target), ("WARC-Date", date), ("Content-Type", made), ("WARC-Block-Digest", sha1(data)), ("WARC-Source-Payload-Digest", source)]
        whole = record([(k, v) for k, v in fields if v], data)
        out.append((key, kind, own, source_id, target, date, list(headers.items()), list(http.items()), source, False not in checks, sha1(data), len(data), title, len(links), content, whole, mime or None, problem))
    return out


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str = "fetched") -> DataFrame:
    """(record_key, record): a response record for every row. ``date`` may be a timestamp column; without it the date is 1970."""
    when = F.date_format(F.col(date).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date in pages.columns else F.lit(None).cast("string")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = list(zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)))
                raw = [response(k, u, h, d or "1970-01-01T00:00:00Z") for k, u, h, d in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(raw, pa.binary())], names=["record_key", "record"])

    return pages.select(F.col(key).cast("string"), F.col(url), F.col(body), when.alias("d")).mapInArrow(run, "record_key string, record binary")


def derive(records: DataFrame) -> DataFrame:
    """Derivatives of (record_key, record). Rows that are null, not a WARC record or no response give none.

    Transfer and content codings are undone (chunked; gzip, deflate, zstd). A payload in another coding, a broken one, or one of
    more than MOST_BYTES has a metadata record only, which names the problem; so have payloads that are no text by their type
    (images, archives), without a problem. HTML is scanned for text, title and links in time that goes with its length; other
    texts are converted as they are. Digests of SHA-1, SHA-2 and MD5 are checked, payload digests against the body as sent or
    without its transfer coding; others can't make digest_ok false. Repeated header fields keep all their values. A page of an
    unknown charset is read as UTF-8, an empty one has an empty text; equal rows give equal rows each, and other columns are left out.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.map_(pa.string(), pa.list_(pa.string()))
        kinds = [*[pa.string()] * 6, strings, strings, pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string()]
        names = [x.split()[0] for x in DERIVED.split(", ")]
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = []
                for k, raw in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    try:
                        rows += derive_one(k, raw or b"")
                    except ValueError:
                        continue
                cols = list(zip(*rows)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return records.select("record_key", "record").mapInArrow(run, DERIVED)


def members(data: bytes) -> Iterator[bytes]:
    """Records of a WARC file, gzip members or plain, one at a time."""
    if data[:2] == b"\x1f\x8b":
        view, at = memoryview(data), 0
        while at < len(data):
            z, parts = zlib.decompressobj(31), []
            while at < len(data) and not z.eof:  # in pieces, so that no member copies the rest of the file
                piece = view[at : at + PIECE]
                parts.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
            yield b"".join(parts) + z.flush()
        return
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        size = int(field(grouped(header_lines(data[at:end])), "Content-Length") or 0)
        yield data[at : end + 4 + size]
        at = end + 8 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_key, record) of WARC files; a file is one task's work, as it is one row of Spark's binary source (2 GB at most)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(*(c.to_pylist() for c in b.columns)):
                for i, raw in enumerate(members(data)):
                    yield pa.RecordBatch.from_arrays([pa.array([f"{name}#{i}"]), pa.array([raw], pa.binary())], names=["record_key", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "record_key string, record binary")


def gzip_members(records: DataFrame) -> DataFrame:
    """(record_key, member): each record as a gzip member; joined members are a .warc.gz file."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.append(None if raw is None else z.compress(raw) + z.flush())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["record_key", "member"])

    return records.select("record_key", "record").mapInArrow(run, "record_key string, member binary")
