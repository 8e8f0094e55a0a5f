"""Page layout: furniture, reading order, tables and headings from text cells.

Cells are (doc_id, page_index, text, x0, y0, x1, y1, font_size). What is counted over pages are aggregates;
what needs a page as a whole is done for each page, whose cells are a bounded list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

PAGE_NUMBER = r"^(?:page|seite|p\.)?\s*[-–]?\s*\d{1,4}\s*[-–]?(?:\s*(?:/|of|von)\s*\d{1,4})?$|^[ivxlc]{1,7}$"
LINES = "doc_id long, page_index long, line int, text string, x0 double, y0 double, x1 double, y1 double, font_size double"


def repetition_key(c: Column) -> Column:
    """Lines that repeat from page to page are one: digits are #, white space is single, case is ignored."""
    return F.lower(t.strip(F.regexp_replace(F.regexp_replace(c, r"\d+", "#"), r"(?U)\s+", " ")))


def is_page_number(c: Column) -> Column:
    return F.lower(t.strip(c)).rlike(PAGE_NUMBER)


def furniture(bands: DataFrame, share: float = 0.3) -> DataFrame:
    """Headers and footers of (doc_id, page_index, band, text): keys on max(2, share of the pages) pages or more, and page numbers."""
    keyed = bands.withColumn("key", repetition_key(F.col("text"))).where("key <> ''")
    pages = bands.groupBy("doc_id").agg(F.count_distinct("page_index").alias("pages"))
    seen = keyed.groupBy("doc_id", "band", "key").agg(F.count_distinct("page_index").alias("on_pages"), F.bool_or(is_page_number(F.col("text"))).alias("is_number"))
    out = seen.join(pages, "doc_id")
    return out.where(F.col("is_number") | (F.col("on_pages") >= F.greatest(F.lit(2), F.bround(F.col("pages") * share, 0)))).select("doc_id", "band", "key", "on_pages", "is_number")


def without_furniture(bands: DataFrame, found: DataFrame) -> DataFrame:
    return bands.withColumn("key", repetition_key(F.col("text"))).join(found.select("doc_id", "band", "key"), ["doc_id", "band", "key"], "left_anti").drop("key")


def triage(pages: DataFrame, threshold: float) -> DataFrame:
    """text_coverage (characters for each 1,000 units of area) and whether a page needs character recognition."""
    cover = F.round(F.col("chars") / F.nullif(F.col("area"), F.lit(0.0)) * 1000, 6)
    return pages.withColumn("text_coverage", cover).withColumn("needs_ocr", F.coalesce(F.col("text_coverage") < threshold, F.lit(True)))


def headings(lines: DataFrame, factor: float = 1.15) -> DataFrame:
    """Lines whose font is larger than the document's median by a factor, short and without a full stop."""
    median = lines.groupBy("doc_id").agg(F.percentile_approx("font_size", 0.5).alias("body"))
    big = (F.col("font_size") >= F.col("body") * factor) & (F.length("text") <= 120) & ~F.col("text").rlike(r"[.!?]\s*$")
    return lines.join(median, "doc_id").withColumn("is_heading", big).drop("body")


def cut(cells: list[dict], gap_x: float, gap_y: float) -> list[dict]:
    """Reading order: split at the widest empty column, then at the widest empty row, as long as there is one."""
    if len(cells) < 2:
        return cells

    def split(lo: str, hi: str, least: float) -> float | None:
        spans = sorted((c[lo], c[hi]) for c in cells)
        end, best, at = spans[0][1], least, None
        for a, b in spans[1:]:
            if a - end >= best:
                best, at = a - end, (a + end) / 2
            end = max(end, b)
        return at

    for lo, hi, least in (("x0", "x1", gap_x), ("y0", "y1", gap_y)):
        if (at := split(lo, hi, least)) is not None:
            return cut([c for c in cells if c[hi] <= at], gap_x, gap_y) + cut([c for c in cells if c[hi] > at], gap_x, gap_y)
    return sorted(cells, key=lambda c: (c["y0"], c["x0"]))


def merge_cells(cells: list[dict]) -> list[dict]:
    """Cells of one baseline whose gap is at most 1.5 font sizes are one line."""
    out: list[dict] = []
    for c in sorted(cells, key=lambda c: (round(c["y1"], 1), c["x0"])):
        p = out[-1] if out else None
        if p and abs(p["y1"] - c["y1"]) <= 0.3 * c["font_size"] and -c["font_size"] <= c["x0"] - p["x1"] <= 1.5 * c["font_size"]:
            p["text"] += (" " if c["x0"] - p["x1"] > 0.15 * c["font_size"] else "") + c["text"]
            p["x1"], p["y0"] = max(p["x1"], c["x1"]), min(p["y0"], c["y0"])
        else:
            out.append(dict(c))
    return out


def merged(page: pd.DataFrame, y: np.ndarray) -> list[dict] | None:
    """merge_cells() of a page by comparing neighbours in its order; y: baselines as they are rounded there.

    None where a line's baselines differ, a cell ends before the one to its left or a number is missing: then the rule
    needs the line so far.
    """
    order = np.lexsort((page.x0.to_numpy(), y))
    x0, y0, x1, y1, size = (page[c].to_numpy()[order] for c in ("x0", "y0", "x1", "y1", "font_size"))
    gap, down = x0[1:] - x1[:-1], np.abs(y1[1:] - y1[:-1])
    one = (down <= 0.3 * size[1:]) & (gap >= -size[1:]) & (gap <= 1.5 * size[1:])
    if np.isnan(x0.sum() + y0.sum() + x1.sum() + y1.sum() + size.sum()) or (down[one] != 0).any() or (x1[1:] < x1[:-1])[one].any():
        return None
    starts = np.flatnonzero(np.r_[True, ~one])
    texts = page.text.to_numpy()[order]
    texts[1:] = np.where(one & (gap > 0.15 * size[1:]), " ", "").astype(object) + texts[1:]
    ends = np.r_[starts[1:], len(order)]
    joined = ["".join(texts[i:j]) for i, j in zip(starts.tolist(), ends.tolist())]
    columns = (joined, x0[starts].tolist(), np.minimum.reduceat(y0, starts).tolist(), x1[ends - 1].tolist(), y1[starts].tolist(), size[starts].tolist())
    return [dict(zip(("text", "x0", "y0", "x1", "y1", "font_size"), r)) for r in zip(*columns)]


def lines_of(page: pd.DataFrame, y: np.ndarray) -> list[dict]:
    sizes = page.font_size.to_numpy()
    size = float(sizes[0] if (sizes == sizes[0]).all() else page.font_size.median()) or 1.0
    lines = merged(page, y) if page.text.notna().all() else None
    return cut(merge_cells(page.to_dict("records")) if lines is None else lines, 1.5 * size, 1.2 * size)


def reading_order(cells: DataFrame) -> DataFrame:
    """Lines of every page in reading order.

    Cells are dealt and sorted by page, and a task reads its pages from batches that hold many of them; a page that goes on in the
    next batch waits for it.
    """
    names = [x.split()[0] for x in LINES.split(", ")]
    cols, by = [c for c in names if c != "line"], ["doc_id", "page_index"]

    def of_pages(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        values, at = np.unique(pdf.y1.to_numpy(), return_inverse=True)
        y, out = np.array([round(v, 1) for v in values.tolist()])[at], {c: [] for c in names}
        docs, pages = pdf.doc_id.to_numpy(), pdf.page_index.to_numpy()
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)]):
            lines = lines_of(pdf.iloc[a:b], y[a:b])
            out["doc_id"] += [docs[a]] * len(lines)
            out["page_index"] += [pages[a]] * len(lines)
            out["line"] += range(len(lines))
            for c in names[3:]:
                out[c] += [x[c] for x in lines]
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = []
        for pdf in batches:
            if not len(pdf):
                continue
            d, p = pdf.doc_id.to_numpy(), pdf.page_index.to_numpy()
            starts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1])])
            if left and (left[0].doc_id.iloc[0], left[0].page_index.iloc[0]) != (d[0], p[0]):
                yield of_pages(pd.concat(left, ignore_index=True), np.array([0]))
                left = []
            if len(starts) > 1:
                whole = pd.concat([*left, pdf.iloc[: starts[-1]]], ignore_index=True)
                before = sum(map(len, left))
                yield of_pages(whole, np.r_[0, starts[1:-1] + before])
                left = []
            left.append(pdf.iloc[starts[-1] :])
        if left:
            yield of_pages(pd.concat(left, ignore_index=True), np.array([0]))

    return cells.select(cols).repartition(*by).sortWithinPartitions(*by).mapInPandas(run, LINES)


def dehyphenate(lines: list[str]) -> str:
    """Lines as one text: a hyphen between small letters at a line's end joins the word."""
    out = ""
    for x in (y.strip() for y in lines):
        if re.search(r"[a-zà-ÿ]-$", out) and re.match(r"[a-zà-ÿ]", x):
            out = out[:-1] + x
        else:
            out = f"{out} {x}" if out else x
    return out


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines of a page joined to paragraphs where the gap to the line before is at most one and a half heights."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        groups, last = [], None
        for r in pdf.itertuples():
            if last is None or not 0 <= r.y0 - last.y1 <= 0.5 * (r.y1 - r.y0) or abs(r.font_size - last.font_size) > 1:
                groups.append([])
            groups[-1].append(r.text)
            last = r
        first = pdf.iloc[0]
        return pd.DataFrame([(first.doc_id, first.page_index, i, dehyphenate(g)) for i, g in enumerate(groups)], columns=["doc_id", "page_index", "paragraph", "text"])

    return lines.groupBy("doc_id", "page_index").applyInPandas(run, "doc_id long, page_index long, paragraph int, text string")


def grid_of(cells: list[dict]) -> list[list[str]]:
    """Cells as a rectangle: rows by baseline, columns by bands of overlapping intervals; what is missing is empty."""
    bands: list[list[float]] = []
    for a, b in sorted((c["x0"], c["x1"]) for c in cells):
        if bands and a <= bands[-1][1]:
            bands[-1][1] = max(bands[-1][1], b)
        else:
            bands.append([a, b])
    rows: list[list[dict]] = []
    for c in sorted(cells, key=lambda c: (c["y1"], c["x0"])):
        if rows and abs(rows[-1][0]["y1"] - c["y1"]) <= 0.6 * (c["y1"] - c["y0"]):
            rows[-1].append(c)
        else:
            rows.append([c])
    out = []
    for row in rows:
        line = [""] * len(bands)
        for c in sorted(row, key=lambda c: c["x0"]):
            i = next(i for i, b in enumerate(bands) if b[0] <= c["x0"] <= b[1])
            line[i] = f"{line[i]} {c['text']}".strip()
        out.append(line)
    return out


def weak_grid(grid: list[list[str]]) -> bool:
    """No table: none, fewer than two columns, or a quarter of the cells or more are empty."""
    cells = [c for r in grid for c in r]
    return not grid or len(grid[0]) < 2 or 4 * sum(not c for c in cells) >= len(cells)


def tables(cells: DataFrame) -> DataFrame:
    """The grid of every page's cells, where it is a table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = grid_of(pdf.to_dict("records"))
        return pd.DataFrame([] if weak_grid(grid) else [(pdf.doc_id.iloc[0], pdf.page_index.iloc[0], grid)], columns=["doc_id", "page_index", "grid"])

    return cells.select("doc_id", "page_index", "text", "x0", "y0", "x1", "y1").groupBy("doc_id", "page_index").applyInPandas(run, "doc_id long, page_index long, grid array<array<string>>")


def section_paths(lines: DataFrame) -> DataFrame:
    """Every line's section: the last heading at or above it on its document."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id").orderBy("page_index", "line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(w))


def style_runs(lines: DataFrame, by: str, order: str, style: str) -> DataFrame:
    """Lines with the length of the ``run`` of neighbours of one style that they stand in."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - F.row_number().over(Window.partitionBy(by, style).orderBy(order))
    return lines.withColumn("__i", place).withColumn("run", F.count(F.lit(1)).over(Window.partitionBy(by, style, "__i"))).drop("__i")
