"""Layout rules on small pages."""

import random

from pyspark.sql import functions as F

from lodestrata.operators import collections as co
from lodestrata.operators import layout

CELL = "doc_id long, page_index long, text string, x0 double, y0 double, x1 double, y1 double, font_size double"


def page(rows, page_index=0):
    return [(1, page_index, t, float(x), float(y), float(x + w), float(y + 10), 10.0) for t, x, y, w in rows]


def test_columns_are_read_one_after_the_other(spark):
    cells = page([("left one", 0, 0, 80), ("left two", 0, 12, 80), ("right one", 200, 0, 80), ("right two", 200, 12, 80)])
    got = layout.reading_order(spark.createDataFrame(cells, CELL)).orderBy("line")
    assert [r.text for r in got.collect()] == ["left one", "left two", "right one", "right two"]


def test_cells_of_a_line_are_merged(spark):
    cells = page([("two", 25, 0, 20), ("one", 0, 0, 20), ("far", 300, 0, 20)])
    assert [r.text for r in layout.reading_order(spark.createDataFrame(cells, CELL)).orderBy("line").collect()] == ["one two", "far"]


def test_grids(spark):
    grid = [["Model", "Accuracy", "F1"], ["Alpha", "89.3", "88.1"], ["Beta", "", "90.5"]]
    cells = page([(t, 100 * x, 20 * y, 50) for y, row in enumerate(grid) for x, t in enumerate(row) if t]) + page([("alone", 0, 0, 50)], 1)
    got = layout.tables(spark.createDataFrame(cells, CELL)).collect()
    assert [(r.page_index, r.grid) for r in got] == [(0, grid)]
    assert layout.weak_grid([]) and layout.weak_grid([["a"]]) and layout.weak_grid([["a", ""], ["b", ""]])


def test_furniture(spark):
    rows = [(1, p, "top", f"Annual  Report {p}") for p in range(5)] + [(1, p, "bottom", f"- {p} -") for p in range(2)] + [(1, 4, "bottom", "a footnote")]
    bands = spark.createDataFrame(rows, "doc_id long, page_index long, band string, text string")
    found = layout.furniture(bands)
    assert {(r.band, r.key) for r in found.collect()} == {("top", "annual report #"), ("bottom", "- # -")}
    assert [r.text for r in layout.without_furniture(bands, found).collect()] == ["a footnote"]


def test_paragraphs_and_sections(spark):
    assert layout.dehyphenate(["an exam-", "ple of", "X-", "Ray"]) == "an example of X- Ray"
    lines = spark.createDataFrame([(1, 0, 0, "Title", 0.0, 0.0, 9.0, 20.0, 20.0), (1, 0, 1, "text one", 0.0, 30.0, 9.0, 40.0, 10.0), (1, 0, 2, "goes on", 0.0, 42.0, 9.0, 52.0, 10.0), (1, 0, 3, "next", 0.0, 80.0, 9.0, 90.0, 10.0)], "doc_id long, page_index long, line int, text string, x0 double, y0 double, x1 double, y1 double, font_size double")
    assert [r.text for r in layout.paragraphs(lines).orderBy("paragraph").collect()] == ["Title", "text one goes on", "next"]
    sections = layout.section_paths(layout.headings(lines)).orderBy("line").collect()
    assert [r.is_heading for r in sections] == [True, False, False, False] and {r.section for r in sections} == {"Title"}


def test_jobs_and_images(spark):
    ev = spark.createDataFrame([("j", 1, "progress", "1/3"), ("j", 2, "warning", "w"), ("j", 3, "progress", "2/3"), ("j", 4, "done", None), ("k", 1, "progress", "x 9")], "job_id string, at long, kind string, message string")
    got = {r.job_id: r for r in co.fold_jobs(ev).collect()}
    assert (got["j"].last_progress, got["j"].warnings, got["j"].state) == ("#/#", 1, "done") and got["k"].state == "running"
    jobs = spark.createDataFrame([("a", "o", "done", 1), ("b", "o", "done", 2), ("c", "o", "running", 0)], "job_id string, owner string, state string, updated_at long")
    assert sorted(r.job_id for r in co.newest(jobs, 1).collect()) == ["b", "c"]
    im = spark.createDataFrame([(bytearray(b"x"), "p2"), (bytearray(b"x"), "p1"), (bytearray(b"x"), "p1"), (bytearray(b"y"), "p3")], "content binary, place string")
    assert {(r.found, r.places) for r in co.images(im).collect()} == {(3, "p1;p2"), (1, "p3")}
    names = spark.createDataFrame([("a",), ("a_images",), ("a_dockv",)], "name string")
    assert [r.name for r in co.visible(names).collect()] == ["a"]
    assert spark.createDataFrame([("An idiotic day",)], "t string").select(co.highlighted(F.col("t"), ["idiot"]).alias("x")).first().x == "An **idiotic** day"


def test_pages_over_several_batches_equal_pages_alone(spark):
    r = random.Random(3)
    rows = [(d, p, f"w{k}", 55.0 * r.randrange(9) + r.choice([0, 0, 3]), 12.0 * r.randrange(5) + r.choice([0, 0, 0, 1]), 50 + r.choice([0, 0, 40])) for d in range(9) for p in range(3) for k in range(r.randrange(1, 40))]
    rows = [(d, p, t, x, y, x + w, y + 10, 10.0) for d, p, t, x, y, w in {(a, b, x, y): (a, b, t, x, y, w) for a, b, t, x, y, w in rows}.values()] + [(7, 9, f"v{k}", 55.0 * (k % 5), 12.0 * (k // 5), 55.0 * (k % 5) + 50, 12.0 * (k // 5) + 10, 10.0) for k in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = layout.reading_order(spark.createDataFrame(rows, CELL).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names, want = CELL.replace(" long", "").replace(" string", "").replace(" double", "").split(", "), []
    for key in {x[:2] for x in rows}:
        page = [dict(zip(names, x)) for x in rows if x[:2] == key]
        want += [(*key, i, *(x[c] for c in names[2:])) for i, x in enumerate(layout.cut(layout.merge_cells(page), 15.0, 12.0))]
    assert sorted(map(tuple, got)) == sorted(want)
    assert "FlatMapGroups" not in layout.reading_order(spark.createDataFrame(rows, CELL))._jdf.queryExecution().executedPlan().toString()
