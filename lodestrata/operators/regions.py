"""Tables, their captions and figures' texts on pages: nearest-above and first-after joins by windows, not by a loop for each page.

Text lines are (doc_id, page_index, line, text), cells (doc_id, page_index, text, x0, y0, x1, y1) with y going up, as in PDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

PAGE = ("doc_id", "page_index")
# How a table's caption, any caption, and a numbered heading begin.
CAPTION, ANY_CAPTION, NUMBERED = r"(?i)^table\s+\d+\s*[:.]", r"(?i)^(table|figure)\s+\d+\s*[:.]", r"^\d+(\.\d+)*\s+[A-Z]"
# Limits of what counts as near, short or prose.
SHORT_LINE, CAPTION_GAP, ROW_TOLERANCE, ROW_GAP, MIN_CELLS, CELL_CHARS, INDENT, LINE_CHARS = 60, 8.0, 0.5, 2.5, 2, 40, 3.0, 60
FIGURE_LINES, FIGURE_SHARE, FIGURE_CHARS = 15, 0.6, 8


def is_caption(c: Column) -> Column:
    return t.strip(c).rlike(CAPTION)


def text_regions(lines: DataFrame) -> DataFrame:
    """(doc_id, page_index, start, end): the tables that captions in the text begin, to their last line.

    A table ends before the first line that can't be of it: a numbered heading, another caption, a line that is neither short nor
    spaced like a table, and after a blank line any that isn't so spaced. Blank lines at the end aren't of it.
    """
    page = Window.partitionBy(*PAGE).orderBy("line")
    text = t.strip(F.col("text"))
    gaps = F.size(F.regexp_extract_all(text, F.lit(r"(?U)(\s{2,})"), 1))
    tabular = (gaps >= 2) | ((gaps >= 1) & (F.length(text) < SHORT_LINE))
    after_blank = F.coalesce(F.lag(text).over(page) == "", F.lit(False))
    breaks = (text != "") & (text.rlike(NUMBERED) | text.rlike(ANY_CAPTION) | ~(tabular | (~after_blank & (F.length(text) < SHORT_LINE))))
    last = F.last(F.when(text != "", F.col("line")), ignorenulls=True)
    rows = lines.select(*PAGE, "line", "text", breaks.alias("breaks"), last.over(page.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), last.over(Window.partitionBy(*PAGE).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    end = F.first(F.when(F.col("breaks"), F.col("before")), ignorenulls=True).over(page.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("end", F.coalesce(end, F.col("last")))
    return rows.where(is_caption(F.col("text"))).select(*PAGE, F.col("line").alias("start"), "end")


def figure_texts(lines: DataFrame, block: str = "block") -> DataFrame:
    """(doc_id, page_index, block, lines, is_figure_text): blocks of many lines that are nearly all of one or two words, and short."""
    own = lines.select(*PAGE, block, t.strip(F.col("text")).alias("text")).withColumn("n", F.length("text"))
    words = F.size(F.split("text", r"(?U)\s+"))
    full = F.col("text") != ""
    n = own.groupBy(*PAGE, block).agg(F.count_if(full).alias("lines"), F.count_if(full & (words <= 2)).alias("short"), F.median(F.when(full, F.col("n"))).alias("median"))
    yes = (F.col("lines") >= FIGURE_LINES) & (F.col("short") >= FIGURE_SHARE * F.col("lines")) & (F.col("median") <= FIGURE_CHARS)
    return n.select(*PAGE, block, "lines", F.coalesce(yes, F.lit(False)).alias("is_figure_text"))


def captions_above(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """regions (doc_id, page_index, region, x0, y0, x1, y1) with ``caption``, the line number of the nearest caption directly above, or null.

    lines: (doc_id, page_index, line, text, y0, y1). Directly above is from one caption's height into the region to eight above it;
    of equally near ones the first line counts.
    """
    height = F.greatest(F.col("l.y1") - F.col("l.y0"), F.lit(1.0))
    gap = F.col("l.y0") - F.col("r.y1")
    at = [F.col(f"r.{c}") == F.col(f"l.{c}") for c in PAGE]
    near = regions.alias("r").join(lines.where(is_caption(F.col("text"))).alias("l"), [*at, gap >= -height, gap <= CAPTION_GAP * height])
    near = near.groupBy(*(F.col(f"r.{c}") for c in PAGE), "r.region").agg(F.min(F.struct(gap.alias("gap"), F.col("l.line").alias("line"))).alias("m"))
    return regions.join(near.select(*PAGE, "region", F.col("m.line").alias("caption")), [*PAGE, "region"], "left")


def page_rows(cells: DataFrame) -> DataFrame:
    """Cells with ``row``, the height of their row's first cell, and ``height``, the page's median. Blank cells are left out.

    A row takes the cells whose bases are at most half a median height below its first one; the distinct bases of a page are folded.
    """
    cells = cells.where(t.strip(F.col("text")) != "")
    height = F.coalesce(F.median(F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))), F.lit(10.0))
    pages = cells.groupBy(*PAGE).agg(height.alias("height"), F.sort_array(F.collect_set("y0"), asc=False).alias("ys"))
    start = F.struct(F.lit(None).cast("double").alias("at"), F.array().cast("array<struct<y0:double,row:double>>").alias("rows"))

    def fold(state: Column, y: Column) -> Column:
        at = F.when(state["at"] - y <= ROW_TOLERANCE * F.col("height"), state["at"]).otherwise(y)
        return F.struct(at.alias("at"), F.concat(state["rows"], F.array(F.struct(y.alias("y0"), at.alias("row")))).alias("rows"))

    rows = pages.select(*PAGE, "height", F.inline(F.aggregate("ys", start, fold, lambda s: s["rows"])))
    return cells.join(rows, [*PAGE, "y0"])


def caption_extents(captions: DataFrame, cells: DataFrame) -> DataFrame:
    """captions (doc_id, page_index, caption, x0, y0) with the box (tx0, ty0, tx1, ty1) of the table below each; null if nothing follows.

    Rows below a caption are skipped as long as they look like its own prose (one cell, a long cell, or a long line that begins where the
    caption does); from the first other one on all belong to the table, up to the first gap of more than 2.5 median heights.
    """
    chars = F.length(t.strip(F.col("text")))
    rows = page_rows(cells).groupBy(*PAGE, "row", "height").agg(
        F.count(F.lit(1)).alias("n"), F.max(chars).alias("longest"), F.sum(chars).alias("chars"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.max("y1").alias("top"), F.min("y0").alias("bottom"))
    below = captions.select(*PAGE, "caption", F.col("x0").alias("cx"), F.col("y0").alias("cy")).join(rows, list(PAGE)).where(F.col("top") <= F.col("cy") + 1)
    prose = (F.col("n") < MIN_CELLS) | (F.col("longest") > CELL_CHARS) | ((F.abs(F.col("left") - F.col("cx")) <= INDENT) & (F.col("chars") > LINE_CHARS))
    down = Window.partitionBy(*PAGE, "caption").orderBy(F.desc("row"))
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = below.withColumn("begun", F.max(~prose).over(so_far))
    gap = F.lag("begun").over(down) & (F.lag("bottom").over(down) - F.col("top") > ROW_GAP * F.col("height"))
    below = below.withColumn("gap", F.coalesce(gap, F.lit(False))).withColumn("ended", F.max("gap").over(so_far)).where("begun and not ended")
    boxes = below.groupBy(*PAGE, "caption").agg(F.min("left").alias("tx0"), F.min("bottom").alias("ty0"), F.max("right").alias("tx1"), F.max("top").alias("ty1"))
    return captions.join(boxes, [*PAGE, "caption"], "left")
