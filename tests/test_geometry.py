"""Geometry of pages against plain recursion and plain grouping."""

import math
import random
from difflib import SequenceMatcher
from statistics import median

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quillwork.operators import geometry as G
from quillwork.sources import tables as T


def cut(ids, box, gap, depth=0):
    if len(ids) > 1 and depth < 12:
        for axis, least in ((1, gap), (0, 0.03)):
            parts, reach = [], None
            for i in sorted(ids, key=lambda i: (box[i][axis], box[i][axis + 2], i)):
                if reach is None or box[i][axis] - reach > least:
                    parts.append([])
                parts[-1].append(i)
                reach = max(box[i][axis + 2], reach if reach is not None else 0)
            if len(parts) > 1:
                return [i for p in parts for i in cut(p, box, gap, depth + 1)]
    return sorted(ids, key=lambda i: (box[i][1], box[i][0]))


boxes = st.lists(st.tuples(*[st.integers(0, 40)] * 4), max_size=14).map(lambda v: [(min(a, c) / 40, min(b, d) / 40, max(a, c) / 40, max(b, d) / 40) for a, b, c, d in v])


@settings(max_examples=300, deadline=None)
@given(st.lists(boxes, min_size=1, max_size=4), st.sampled_from([0.004, 0.02, 0.1]))
def test_cuts_of_many_pages_are_those_of_each(pages, gap):
    flat = np.array([b for p in pages for b in p], float).reshape(-1, 4)
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    place = G.in_reading_order(flat, page, np.full(len(flat), gap))
    base = 0
    for p in pages:
        order = cut(list(range(len(p))), p, gap)
        got = np.argsort(place[base : base + len(p)]).tolist()
        assert [p[i][:2] for i in got] == [p[i][:2] for i in order]  # boxes of one corner are told apart by nothing
        base += len(p)


def test_columns_are_read_one_by_one_and_tilt_is_undone(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for page, degrees in ((1, 0.0), (2, 1.5), (3, -3.0), (4, 0.1)):
        a = math.radians(degrees)
        turn = lambda x, y: (0.5 + (x - 0.5) * math.cos(a) - (y - 0.5) * math.sin(a), 0.5 + (x - 0.5) * math.sin(a) + (y - 0.5) * math.cos(a))  # noqa: B023, E731
        flat = [(0.1, 0.05, 0.9, 0.08)] + [(0.1 + c * 0.42, 0.12 + i * 0.03, 0.47 + c * 0.42, 0.14 + i * 0.03) for c in (0, 1) for i in range(25)]
        ids = list(range(len(flat)))
        rng.shuffle(ids)
        want[page] = ids
        for i, (x0, y0, x1, y1) in zip(ids, flat, strict=True):
            (px, py), (qx, qy) = turn(x0, y0), turn(x1, y1)
            ex, ey = turn(x1, y0)
            rows.append((page, i, min(px, qx), min(py, qy), max(px, qx), max(py, qy), ex - px, ey - py))
    rows += [(5, 1, None, 0.1, 0.2, 0.3, 1.0, 0.0), (5, 0, 0.5, 0.5, 0.6, 0.6, 1.0, 0.0), (6, 7, float("nan"), 0.1, 0.2, 0.3, None, None)]
    df = spark.createDataFrame(rows, "page int, id int, x0 double, y0 double, x1 double, y1 double, dx double, dy double")
    got = {}
    for r in G.reading_order(df, ["page"], "id", ["x0", "y0", "x1", "y1"], ("dx", "dy")).sort("page", "place").collect():
        got.setdefault(r.page, []).append(r.id)
    assert got == want | {5: [0, 1], 6: [7]}
    assert G.reading_order(df.where("1 = 0"), ["page"], "id", ["x0", "y0", "x1", "y1"]).collect() == []


def test_median_tilt_of_what_can_be_mended(spark):
    rows = [(1, 1.0, math.tan(math.radians(d))) for d in (1, 2, 3, 40)] + [(2, 1.0, 0.001), (3, -1.0, 0.0), (4, None, None)]
    got = {r.p: r.t for r in spark.createDataFrame(rows, "p int, dx double, dy double").groupBy("p").agg(G.tilt(F.col("dx"), F.col("dy")).alias("t")).collect()}
    assert abs(got[1] - 2) < 1e-9 and got[2] == got[3] == got[4] == 0


def plain_margins(rows):
    """Every line against the first of each series, in order; nothing is looked up."""
    pages = {}
    for r in rows:
        pages.setdefault(r.page, []).append(r)
    lines = []
    for page in sorted(pages):
        texts = {"header": [], "footer": []}
        for r in sorted(pages[page], key=lambda r: r.id):
            y = (r.y0 + r.y1) / 2
            zone = "header" if y <= 0.15 else "footer" if y >= 0.85 else None
            if not zone or r.y1 - r.y0 > 0.08 or r.kind == "heading":
                continue
            if r.kind == "image":
                lines.append((page, zone, None, r.image, [r]))
            else:
                texts[zone].append(r)
        for zone, items in texts.items():
            groups = []
            for r in sorted(items, key=lambda r: ((r.y0 + r.y1) / 2, r.x0)):
                last = groups and groups[-1][-1]
                if last and abs((last.y0 + last.y1) / 2 - (r.y0 + r.y1) / 2) <= 0.012 and r.x0 - last.x1 <= 0.06:
                    groups[-1].append(r)
                else:
                    groups.append([r])
            lines += [(page, zone, " ".join(x.text for x in g), None, g) for g in groups]
    centre = lambda g: ((min(r.x0 for r in g) + max(r.x1 for r in g)) / 2, (min(r.y0 for r in g) + max(r.y1 for r in g)) / 2)

    def match(a, b):
        if a[1] != b[1] or any(abs(u - v) > 0.035 for u, v in zip(centre(a[4]), centre(b[4]), strict=True)) or (a[3] is None) != (b[3] is None):
            return False
        if a[3] is not None:
            return bin(a[3] ^ b[3]).count("1") <= 8
        n = [G.page_number(x[2]) is not None for x in (a, b)]
        return all(n) if any(n) else SequenceMatcher(None, G.comparable(a[2]), G.comparable(b[2])).ratio() >= 0.84

    series = []
    for line in lines:
        for s in series:
            if match(s[0], line):
                s.append(line)
                break
        else:
            series.append([line])
    out = []
    for s in series if len(pages) >= 3 else ():
        options = []
        for parity in (None, 0, 1):
            mine = sorted({x[0]: x for x in s if parity is None or x[0] % 2 == parity}.items())
            span = [p for p in range(mine[0][0], mine[-1][0] + 1) if parity is None or p % 2 == parity] if mine else []
            if len(mine) >= (2 if len(pages) <= 5 else 3) and len(mine) >= 0.6 * len(span):
                options.append([x for _, x in mine])
        if options:
            best = max(options, key=len)
            number = best[0][2] is not None and G.page_number(best[0][2]) is not None
            if number:
                gaps = [G.page_number(x[2]) - x[0] for x in best]
                if max(map(gaps.count, gaps)) < 0.6 * len(gaps):
                    continue
            out.append(("page_number" if number else best[0][1], "text" if best[0][3] is None else "image", tuple(x[0] for x in best)))
    return sorted(out)


def test_running_margins_against_plain_grouping(spark, sf_dir):
    elements = T.margins(spark, sf_dir)
    rows, by = elements.collect(), {}
    for r in rows:
        by.setdefault(r.material, []).append(r)
    got = {}
    for r in G.running_margins(elements).collect():
        got.setdefault(r.material, []).append((r.kind, r.element, tuple(r.pages)))
    assert {m: sorted(v) for m, v in got.items()} == {m: v for m in by if (v := plain_margins(by[m]))}
    assert {k for v in got.values() for k, *_ in v} == {"header", "footer", "page_number"}


def test_margin_lines_of_odd_elements(spark):
    box = lambda x, y, w=0.1, h=0.02: (x, y, x + w, y + h)
    rows = [("m", 1, 0, "paragraph", "left", None, *box(0.1, 0.05)), ("m", 1, 1, "paragraph", "right", None, *box(0.25, 0.05)), ("m", 1, 2, "paragraph", "far", None, *box(0.6, 0.05)),
            ("m", 1, 3, None, "no kind", None, *box(0.1, 0.95)), ("m", 1, 4, "heading", "h", None, *box(0.1, 0.1)), ("m", 1, 5, "paragraph", "two\nlines", None, *box(0.1, 0.02)), ("m", 1, 6, "paragraph", " ", None, *box(0.1, 0.02)),
            ("m", 1, 7, "image", None, None, *box(0.1, 0.02)), ("m", 1, 8, "image", "x", 5, *box(0.3, 0.9)), ("m", 1, 9, "paragraph", "body", None, *box(0.1, 0.5)), ("m", 1, 10, "paragraph", "high", None, *box(0.1, 0.0, 0.1, 0.2)), ("m", 1, 11, "paragraph", "none", None, None, 0.1, 0.2, 0.12)]
    df = spark.createDataFrame(rows, "material string, page int, id int, kind string, text string, image long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.zone, r.place, r.text, r.image) for r in G.margin_lines(df).collect())
    assert got == [("footer", 3, "no kind", None), ("footer", 8, None, 5), ("header", 0, "left right", None), ("header", 2, "far", None)]
    assert G.running_margins(df).collect() == [] and G.running_margins(df.where("1 = 0")).collect() == []
    assert [G.page_number(x) for x in ("Page 12", "– iv –", "[7]", "стр. 3", "12a", "", "XIX")] == [12, 4, 7, 3, None, None, 19]
