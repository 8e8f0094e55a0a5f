"""Regions of pages against one loop for each page."""

import random
import re
import statistics

from lodestrata.operators import regions

CELLS = "doc_id long, page_index long, text string, x0 double, y0 double, x1 double, y1 double"


def test_text_regions_equal_a_scan(spark):
    r = random.Random(3)
    kinds = ["", "", "Table 1: a caption", "  table 22 . b", "Table x", "Figure 3: c", "1.2 Heading", "short prose", "a  b  c", "a  b", "long " * 15, "x  " + "long " * 15, "long  " * 12, " \t"]
    pages = {(d, p): [r.choice(kinds) for _ in range(r.randrange(1, 25))] for d in range(6) for p in range(8)}
    rows = [(d, p, i, x) for (d, p), lines in pages.items() for i, x in enumerate(lines)]
    want = set()
    for (d, p), lines in pages.items():
        i = 0
        while i < len(lines):
            if not re.match(r"table\s+\d+\s*[:.]", lines[i].strip(), re.I):
                i += 1
                continue
            end, blank = i, False
            for j in range(i + 1, len(lines)):
                x = lines[j].strip()
                if not x:
                    blank = True
                    continue
                gaps = len(re.findall(r"\s{2,}", x))
                tabular = gaps >= 2 or gaps >= 1 and len(x) < 60
                if re.match(r"\d+(\.\d+)*\s+[A-Z]", x) or re.match(r"(table|figure)\s+\d+\s*[:.]", x, re.I) or not (tabular or not blank and len(x) < 60):
                    break
                end, blank = j, False
            want.add((d, p, i, end))
            i = end + 1
    got = regions.text_regions(spark.createDataFrame(rows, "doc_id long, page_index long, line int, text string").repartition(3))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 50


def test_figure_texts(spark):
    blocks = {0: ["ab"] * 15, 1: ["ab"] * 14, 2: ["a long line of words"] * 20, 3: ["one two"] * 9 + ["a b c"] * 6, 4: ["one two"] * 8 + ["a b c"] * 7, 5: ["nine char"] * 16, 6: ["x", " "] * 15, 7: ["eight ch"] * 8 + ["nine char"] * 8}
    rows = [(1, 1, b, x) for b, lines in blocks.items() for x in lines]
    got = {x.block: x.is_figure_text for x in regions.figure_texts(spark.createDataFrame(rows, "doc_id long, page_index long, block int, text string")).collect()}

    def plain(lines):
        lines = [x.strip() for x in lines if x.strip()]
        return len(lines) >= 15 and sum(len(x.split()) <= 2 for x in lines) >= 0.6 * len(lines) and statistics.median(map(len, lines)) <= 8

    assert got == {b: plain(lines) for b, lines in blocks.items()} and set(got.values()) == {True, False}


def test_captions_above_and_extents_equal_loops(spark):
    r = random.Random(7)
    cells, captions = [], []
    for d in range(25):
        y = 800.0
        for _ in range(r.randrange(3, 14)):
            y -= r.choice([12, 12, 12, 14, 30, 45])
            base = y
            for k in range(r.choice([1, 2, 3, 4])):
                text = r.choice(["ab", "12.5", "x" * 45, " ", "w " * 12])
                x = 50 + 90 * k + r.choice([0, 0, 2])
                cells.append((d, 0, text, float(x), base - r.choice([0, 0, 1, 4.9]), x + 60.0, base + 10.0))
        for c in range(2):
            captions.append((d, 0, c, 50.0 + r.choice([0, 40]), float(r.randrange(500, 800))))
    got = regions.caption_extents(spark.createDataFrame(captions, "doc_id long, page_index long, caption int, x0 double, y0 double"), spark.createDataFrame(cells, CELLS).repartition(3))
    found = {(x.doc_id, x.caption): (x.tx0, x.ty0, x.tx1, x.ty1) for x in got.collect()}
    some = 0
    for d, _, c, cx, cy in captions:
        own = [x for x in cells if x[0] == d and x[2].strip()]
        height = statistics.median(x[6] - x[4] for x in own) if own else 10
        rows = []
        for x in sorted(own, key=lambda x: (-x[4], x[3])):
            if rows and abs(rows[-1][0][4] - x[4]) <= 0.5 * height:
                rows[-1].append(x)
            else:
                rows.append([x])
        members, last = [], None
        for row in (sorted(row, key=lambda x: x[3]) for row in rows):
            if max(x[6] for x in row) > cy + 1:
                continue
            prose = len(row) < 2 or any(len(x[2].strip()) > 40 for x in row) or abs(row[0][3] - cx) <= 3 and sum(len(x[2].strip()) for x in row) > 60
            if not members and prose:
                continue
            if members and last - max(x[6] for x in row) > 2.5 * height:
                break
            members += row
            last = min(x[4] for x in row)
        want = (min(x[3] for x in members), min(x[4] for x in members), max(x[5] for x in members), max(x[6] for x in members)) if members else (None,) * 4
        assert found[d, c] == want
        some += bool(members)
    assert 5 < some < len(captions)
    lines = [(d, 0, i, r.choice(["Table 1: x", "Table 2. y", "prose", "Tables"]), y, y + r.choice([0.0, 8.0, 12.0])) for d in range(30) for i, y in enumerate(float(r.randrange(0, 300)) for _ in range(8))]
    boxes = [(d, 0, k, 0.0, 0.0, 9.0, float(r.randrange(0, 300))) for d in range(31) for k in range(2)]
    got = regions.captions_above(spark.createDataFrame(boxes, "doc_id long, page_index long, region int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(lines, "doc_id long, page_index long, line int, text string, y0 double, y1 double"))
    found = {(x.doc_id, x.region): x.caption for x in got.collect()}
    for d, _, k, _, _, _, top in boxes:
        near = [(y0 - top, i) for dd, _, i, text, y0, y1 in lines if dd == d and re.match(r"Table \d+[:.]", text) and -max(y1 - y0, 1) <= y0 - top <= 8 * max(y1 - y0, 1)]
        assert found[d, k] == (min(near)[1] if near else None)
    assert len(found) == len(boxes) and any(v is not None for v in found.values())
