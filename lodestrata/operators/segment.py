"""Chunking: paragraphs, sentences, budgets, and layout helpers as row generators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as t

SENTENCE = re.compile(r"[^.!?。！？]*[.!?。！？]+[\"')\]]*\s*|[^.!?。！？]+$", re.S)
CHUNKS = "doc_id long, node_id string, parent_id string, hier_level int, hier_type string, part int, text string"


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, text): non-blank paragraphs between empty lines."""
    return docs.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("ord", "text")).where(t.non_blank(F.col("text")).isNotNull())


def pack_sentences(text: str, most: int) -> list[str]:
    """Sentences joined up to ``most`` characters; a longer sentence is cut at blanks, a word longer than that anywhere."""
    out, now = [], ""
    for s in SENTENCE.findall(text):
        while len(s) > most:
            cut = s.rfind(" ", 1, most + 1)
            cut = cut if cut > 0 else most
            if now:
                out.append(now)
                now = ""
            out.append(s[:cut])
            s = s[cut:]
        if now and len(now) + len(s) > most:
            out.append(now)
            now = ""
        now += s
    return [x.strip() for x in [*out, now] if x.strip()]


def hierarchy(docs: DataFrame, coarse: int = 4000, fine: int = 800) -> DataFrame:
    """Coarse chunks of paragraphs and their fine chunks: node ids are hashes of (document, level, place), so reruns agree."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        name = lambda *x: hashlib.sha256(":".join(map(str, x)).encode()).hexdigest()[:16]
        for f in frames:
            rows = []
            for doc, text in zip(f.doc_id, f.text):
                groups, now = [], ""
                for p in re.split(r"\n\s*\n", text or ""):
                    if now and len(now) + len(p) + 2 > coarse:
                        groups.append(now)
                        now = ""
                    now = f"{now}\n\n{p}" if now else p
                part = 0
                for i, g in enumerate(x for g in [*groups, now] for x in pack_sentences(g, coarse)):
                    parent = name(doc, 1, i)
                    rows.append((doc, parent, None, 1, "coarse", i, g))
                    for s in pack_sentences(g, fine):
                        rows.append((doc, name(doc, 2, part), parent, 2, "fine", part, s))
                        part += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(cut, CHUNKS)


def budget_split(chunks: DataFrame, tokens: int, ratio: float = 3.5, margin: float = 0.95) -> DataFrame:
    """Chunks over a token budget in parts with part_index and total_parts; others are one part."""
    most = int(tokens * margin * ratio)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: pack_sentences(x or "", most) or [x or ""])

    parts = F.when(t.fits(F.col("text"), tokens, margin), F.array("text")).otherwise(split("text"))
    out = chunks.withColumn("parts", parts).withColumn("total_parts", F.size("parts"))
    return out.select(*[c for c in chunks.columns if c != "text"], F.posexplode("parts").alias("part_index", "text"), "total_parts")


def html_grids(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table, grid array<array<string>>): every table of a page as a rectangle, row and column spans repeated."""

    def grid(source: str) -> list[list[list[str]]]:
        from html.parser import HTMLParser

        class Tables(HTMLParser):
            def __init__(self):
                super().__init__()
                self.done, self.rows, self.cell = [], None, None

            def handle_starttag(self, tag, attrs):
                a = dict(attrs)
                if tag == "table":
                    self.rows = []
                elif tag == "tr" and self.rows is not None:
                    self.rows.append([])
                elif tag in ("td", "th") and self.rows:
                    span = [min(1000, int(a.get(k) or 1)) if str(a.get(k) or 1).isdigit() else 1 for k in ("rowspan", "colspan")]
                    self.cell = ["", *span]
                    self.rows[-1].append(self.cell)

            def handle_endtag(self, tag):
                if tag in ("td", "th"):
                    self.cell = None
                elif tag == "table" and self.rows is not None:
                    self.done.append(self.rows)
                    self.rows = self.cell = None

            def handle_data(self, data):
                if self.cell is not None:
                    self.cell[0] += data

        p = Tables()
        p.feed(source or "")
        out = []
        for rows in p.done:
            cells: dict[tuple[int, int], str] = {}
            for y, row in enumerate(rows):
                x = 0
                for text, down, across in row:
                    while (y, x) in cells:
                        x += 1
                    for dy in range(max(1, down)):
                        for dx in range(max(1, across)):
                            cells[y + dy, x + dx] = " ".join(text.split())
                    x += max(1, across)
            if cells:
                h, w = (max(k[i] for k in cells) + 1 for i in (0, 1))
                out.append([[cells.get((y, x), "") for x in range(w)] for y in range(h)])
        return out

    @F.pandas_udf("array<array<array<string>>>")
    def grids(texts: pd.Series) -> pd.Series:
        return texts.map(grid)

    held = pages.where(F.contains(F.lower(html), F.lit("<table")))
    return held.select(key, F.posexplode(grids(html)).alias("table", "grid"))


def grid_text(grid):
    """Rows as lines, cells joined by a bar."""
    return F.array_join(F.transform(grid, lambda r: F.array_join(r, " | ")), "\n")


def child_arrays(children: DataFrame, parent: str, order: str, array: str) -> DataFrame:
    """Arrays of children joined for their parent in the children's order."""
    return children.groupBy(parent).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, array))), lambda x: x[array])).alias(array))


def overlapping(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks and regions of one page whose boxes overlap (page_id, x0, y0, x1, y1): an equi-join by page with the boxes as condition."""
    b, r = blocks.alias("b"), regions.alias("r")
    on = (F.col("b.page_id") == F.col("r.page_id")) & (F.col("b.x0") < F.col("r.x1")) & (F.col("r.x0") < F.col("b.x1")) & (F.col("b.y0") < F.col("r.y1")) & (F.col("r.y0") < F.col("b.y1"))
    return b.join(r, on).select("b.page_id", F.col("b.block_id"), F.col("r.region_id"))


def guarded(rows: DataFrame, text: str, budget: int, ratio: float = 3.5) -> tuple[DataFrame, Observation]:
    """rows, of which one whose text is estimated over the budget stops the job that reads them, so that nothing of it is committed.

    The second value has rows, tokens and largest once the job has run, without another scan.
    """
    tokens = t.estimated_tokens(F.coalesce(F.col(text), F.lit("")), ratio)
    over = F.raise_error(F.concat(F.lit("a text of "), tokens.cast("string"), F.lit(f" tokens is over the budget of {budget}")))
    out = rows.withColumn("__tokens", F.when(tokens <= budget, tokens).otherwise(over))
    seen = Observation()
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("__tokens"), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.max("__tokens"), F.lit(0)).cast("long").alias("largest"))
    return out.drop("__tokens"), seen
