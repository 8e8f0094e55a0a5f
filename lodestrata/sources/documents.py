"""JSON, transcripts and office files as documents; every file is parsed by the task that reads it."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

SEGMENT = "text string, start_ts string, end_ts string, start_seconds double, end_seconds double, speaker string, language string, detected_language string, task string, source_file string, source_file_hash string"
FILES = "path string, file_hash string, mimetype string, text string"


def key_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """All paths of an inferred JSON schema, arrays as their elements, sorted."""
    out = []
    for f in schema.fields:
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        out.append(prefix + f.name)
        if isinstance(kind, T.StructType):
            out += key_paths(kind, f"{prefix}{f.name}.")
    return sorted(out)


def json_documents(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """Each JSON object as one document (its JSON is the text). Line formats are read in parts, one file holding an array as a whole."""
    lines = path.rstrip("/").endswith((".jsonl", ".ndjson")) if lines is None else lines
    df = spark.read.option("multiLine", not lines).json(path)
    return df.select(F.to_json(F.struct("*")).alias("text"), F.lit(",".join(key_paths(df.schema))).alias("nested_keys"))


def is_transcript(df: DataFrame) -> bool:
    have = set(df.columns)
    return "text" in have and ({"start_ts", "end_ts"} <= have or {"start_seconds", "end_seconds"} <= have)


def transcript(segments: DataFrame, most: int | None = None) -> DataFrame:
    """Segments with text, each time given both as seconds and as clock, numbered from 0 within their source file in order of time.

    ``most``: keep so many segments of a file only (a guard for single files; off by default).
    """
    for part in SEGMENT.split(", "):
        name, kind = part.split(" ")
        if name not in segments.columns:
            segments = segments.withColumn(name, F.lit(None).cast(kind))
    from pyspark.sql.window import Window

    out = segments.withColumn("text", t.strip(F.col("text"))).where("text <> ''")
    for edge in ("start", "end"):
        s = F.coalesce(F.col(f"{edge}_seconds").try_cast("double"), t.seconds(F.col(f"{edge}_ts")))
        out = out.withColumn(f"{edge}_seconds", s).withColumn(f"{edge}_ts", F.coalesce(t.non_blank(F.col(f"{edge}_ts")), F.when(s.isNotNull(), t.clock(s))))
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("start_seconds", "end_seconds", "text")) - 1
    out = out.withColumn("sentence_index", number)
    return out if most is None else out.where(F.col("sentence_index") < most)


def rtf_text(data: bytes) -> str:
    """Plain text of RTF: control words that break lines become breaks, hidden groups and other controls go."""
    raw = data.decode("latin-1")
    out, stack, hidden, at, skip = [], [], False, 0, 1
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
    fonts = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata", "listtable"}
    drop = 0
    for m in token.finditer(raw, at):
        word, number, byte, mark, brace, plain = m.groups()
        if brace == "{":
            stack.append((hidden, skip))
        elif brace == "}":
            hidden, skip = stack.pop() if stack else (False, 1)
        elif mark == "*" or word in fonts:
            hidden = True
        elif word == "uc":
            skip = int(number or 1)
        elif hidden:
            continue
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            drop = skip
        elif byte:
            if drop:
                drop -= 1
            else:
                out.append(bytes.fromhex(byte).decode("cp1252", "replace"))
        elif mark in ("\\", "{", "}", "~"):
            out.append(" " if mark == "~" else mark)
        elif plain:
            out.append(plain[drop:])
            drop = 0
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX, cells of a table row joined by bars."""
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    said = lambda e: "".join((x.text or "") if x.tag == f"{w}t" else "\t" if x.tag == f"{w}tab" else "\n" if x.tag == f"{w}br" else "" for x in e.iter())
    out = []
    for e in body:
        if e.tag == f"{w}p":
            out.append(said(e))
        elif e.tag == f"{w}tbl":
            out += [" | ".join(said(c).strip() for c in r.findall(f"{w}tc")) for r in e.findall(f"{w}tr")]
    return "\n".join(x for x in out if x.strip())


def xlsx_rows(data: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet as text."""
    from xml.etree import ElementTree

    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(x.text or "" for x in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))))
    out = []
    for row in sheet.iter(f"{m}row"):
        cells: dict[int, str] = {}
        for i, c in enumerate(row.findall(f"{m}c")):
            letters = re.match(r"[A-Z]+", c.get("r") or "")
            x = sum((ord(k) - 64) * 26**p for p, k in enumerate(reversed(letters[0]))) - 1 if letters else i
            v = c.find(f"{m}v")
            value = "" if v is None else v.text or ""
            cells[x] = shared[int(value)] if c.get("t") == "s" else "".join(k.text or "" for k in c.iter(f"{m}t")) if c.get("t") == "inlineStr" else value
        out.append([cells.get(x, "") for x in range(max(cells, default=-1) + 1)])
    return out


def parse(name: str, data: bytes) -> str:
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "docx":
        return docx_text(data)
    if kind == "rtf":
        return rtf_text(data)
    if kind == "xlsx":
        return "\n".join(" | ".join(r) for r in xlsx_rows(data))
    return data.decode("utf-8", "replace") if kind in ("txt", "md", "csv", "tsv", "json", "jsonl", "ndjson", "html") else ""


def files(spark: SparkSession, path: str, known_hashes: DataFrame | None = None) -> DataFrame:
    """(path, file_hash, mimetype, text) of all files below a folder whose hash isn't known; a file that can't be parsed has a null text."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content", F.sha2("content", 256).alias("file_hash"), t.mime_of_name(F.col("path")).alias("mimetype"))
    if known_hashes is not None:
        f = f.join(known_hashes.select("file_hash"), "file_hash", "left_anti")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            texts = []
            for name, data in zip(x.path, x.content):
                try:
                    texts.append(parse(name, bytes(data)))
                except Exception:  # a broken file must not stop the others
                    texts.append(None)
            yield x[["path", "file_hash", "mimetype"]].assign(text=texts)

    return f.select("path", "content", "file_hash", "mimetype").mapInPandas(read, FILES)


def new_by_hash(docs: DataFrame, known: DataFrame, hash_column: str = "file_hash") -> DataFrame:
    """Documents whose hash isn't known; those without a hash stay. One row of each hash."""
    fresh = docs.join(known.select(hash_column).distinct(), hash_column, "left_anti")
    return fresh.where(F.col(hash_column).isNotNull()).dropDuplicates([hash_column]).unionByName(fresh.where(F.col(hash_column).isNull()))
