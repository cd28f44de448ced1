"""Page geometry: reading order by cutting a page along its white bands, the tilt of scans, running headers and footers."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import groups
from . import structure

# Fixed values, in shares of the page: the least white band between columns, and between rows as a share of the median
# height of a box and at least; levels of cuts; degrees of tilt that are corrected.
COLUMN_GAP, ROW_SHARE, ROW_GAP, LEVELS = 0.03, 0.6, 0.004, 12
TILT_LEAST, TILT_MOST = 0.15, 8.0


def tilt(dx: Column, dy: Column) -> Column:
    """Of a page's lines (an aggregate): the median angle in degrees of their upper edges from (0, 0) to (dx, dy), of those
    that a correction could mend; 0 where there are none, or where it is too small to matter."""
    angle = F.degrees(F.atan2(dy, dx))
    middle = F.median(F.when((dx > 0) & (F.abs(angle) <= TILT_MOST), angle))
    return F.when(F.abs(middle) >= TILT_LEAST, middle).otherwise(0.0)


def _upright(box: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Boxes turned back about the page's middle by their pages' angles, as rectangles again."""
    turn = np.radians(-angle)
    cos, sin = np.cos(turn), np.sin(turn)
    dx, dy = box[:, 0::2] - 0.5, box[:, 1::2] - 0.5
    x, y = 0.5 + dx * cos[:, None] - dy * sin[:, None], 0.5 + dx * sin[:, None] + dy * cos[:, None]
    turned = np.stack([x.min(axis=1), y.min(axis=1), x.max(axis=1), y.max(axis=1)], axis=1)
    return np.where((angle == 0)[:, None], box, turned)


def _median_heights(box: np.ndarray, page: np.ndarray, pages: int) -> np.ndarray:
    """By page, the median of the heights that aren't zero; 0 where there are none."""
    height = box[:, 3] - box[:, 1]
    high = np.flatnonzero(height > 0)
    order = high[np.lexsort((height[high], page[high]))]
    n = np.bincount(page[high], minlength=pages)
    first, out = np.cumsum(n) - n, np.zeros(pages)
    some = n > 0
    out[some] = (height[order[(first + (n - 1) // 2)[some]]] + height[order[(first + n // 2)[some]]]) / 2
    return out


def _reach(end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The largest end so far within each row's group; groups are stretches."""
    values, rank = np.unique(end, return_inverse=True)
    fresh = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
    return values[np.maximum.accumulate(rank + fresh * len(values)) - fresh * len(values)]


def _bands(box: np.ndarray, group: np.ndarray, at: np.ndarray, axis: int, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``at`` in the order of their groups and of where their boxes begin on an axis, and whether a white band wider than
    ``gap`` is before each within its group."""
    order = at[np.lexsort((at, box[at, axis + 2], box[at, axis], group[at]))]
    g = group[order]
    cut = np.zeros(len(order), bool)
    cut[1:] = (g[1:] == g[:-1]) & (box[order[1:], axis] - _reach(box[order, axis + 2], g)[:-1] > gap[order[1:]])
    return order, cut


def in_reading_order(box: np.ndarray, page: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The places (from 0, over all pages together) of boxes (x0, y0, x1, y1 as rows); ``page`` doesn't fall, ``gap`` is the least
    band between rows.

    All groups of all pages are cut together, level by level: along y where white bands cross the group, else along x. What
    can't be cut any more is read from top to bottom, then from left to right.
    """
    n = len(box)
    group = page.astype(np.int64)  # grows in reading order
    held = np.arange(n)  # rows as they were last arranged, which decides between boxes with the same corner
    live = np.ones(n, bool)
    for _ in range(LEVELS):
        number, size = np.unique(group, return_inverse=True, return_counts=True)[1:]
        live &= size[number] > 1
        at = np.flatnonzero(live)
        if not len(at):
            break
        part, was = np.zeros(n, np.int64), np.zeros(n, bool)
        for axis, width in ((1, gap), (0, np.full(n, COLUMN_GAP))):
            if not len(at):
                break
            order, cut = _bands(box, group, at, axis, width)
            g = group[order]
            first = np.concatenate([[True], g[1:] != g[:-1]])
            total = np.cumsum(cut)
            parts = total - total[first][np.cumsum(first) - 1]
            split = np.isin(g, g[cut])
            part[order[split]] = parts[split]
            was[order[split]] = True
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(len(order))
            held[order[split]] = n + rank[order[split]]
            at = order[~split]
        live &= was
        group = np.unique(np.stack([group, part]), axis=1, return_inverse=True)[1].reshape(-1)
    place = np.empty(n, np.int64)
    place[np.lexsort((held, box[:, 0], box[:, 1], group))] = np.arange(n)
    return place


def reading_order(elements: DataFrame, page: list[str], key: str, box: list[str], edge: tuple[str, str] | None = None) -> DataFrame:
    """``page`` columns, ``key`` and place: where each element comes on its page (from 0) when it is read.

    ``box`` names x0, y0, x1, y1 in shares of the page; ``edge``, if given, the upper edge's run and rise (dx, dy), from which
    the page's tilt is made. Tilt is taken out for the order only. Elements without a whole box come last, by ``key``. A page's
    elements are one row of one task; pages are cut together in numpy, a batch at a time. No elements give no rows.
    """
    kind = dict(elements.dtypes)[key]
    whole = F.lit(True)
    for c in box:
        whole &= F.col(c).isNotNull() & ~F.isnan(c)
    item = F.struct(F.col(key).alias("key"), whole.alias("whole"), *(F.col(c).cast("double").alias(f"b{i}") for i, c in enumerate(box)))
    angle = tilt(*(F.col(c).cast("double") for c in edge)) if edge else F.lit(0.0)
    pages = elements.groupBy(*page).agg(F.array_sort(F.collect_list(item)).alias("items"), angle.alias("angle"))
    rows = pages.select(F.struct(*page).alias("page"), "items", "angle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes = batch.column(1).flatten(), np.diff(batch.column(1).offsets.to_numpy())
            of = np.repeat(np.arange(batch.num_rows), sizes)
            flat = np.stack([items.field(f"b{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(4)], axis=1).reshape(-1, 4)
            use = items.field("whole").to_numpy(zero_copy_only=False).astype(bool)
            flat[use] = _upright(flat[use], batch.column(2).to_numpy()[of[use]])
            gap = np.maximum(ROW_GAP, ROW_SHARE * _median_heights(flat[use], of[use], batch.num_rows))
            order = np.concatenate([np.flatnonzero(use)[np.argsort(in_reading_order(flat[use], of[use], gap[of[use]]))], np.flatnonzero(~use)])
            order = order[np.argsort(of[order], kind="stable")]
            within = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[order])), items.field("key").take(pa.array(order)), pa.array(within)], names=["page", "key", "place"])

    out = rows.mapInArrow(run, f"page {dict(rows.dtypes)['page']}, key {kind}, place bigint")
    return out.select(*(F.col("page")[c].alias(c) for c in page), F.col("key").alias(key), "place")


# Fixed values of running headers and footers: the margin, the highest element that counts, how far pieces of one line may be
# apart (down and across), how far lines of one series may be (to either side), their least similarity, the most bits that
# images' hashes differ in, the least share of pages (of all, or of one parity) between a series' first and last page, the
# least pages of a material, and a series' least pages in materials of up to SHORT pages, and in longer ones.
MARGIN, HIGHEST, LINE_DOWN, LINE_ACROSS, NEAR, ALIKE, BITS, COVERED, PAGES, SHORT, FEW, MANY = 0.15, 0.08, 0.012, 0.06, 0.035, 0.84, 8, 0.6, 3, 5, 2, 3
# Fixed value: what a page number looks like.
PAGE_NUMBER = re.compile(r"^\s*(?:стр(?:аница)?\.?|page|p\.?)?\s*[-–—(\[]*\s*(?P<number>\d{1,4}|[ivxlcdm]{1,10})\s*[-–—)\]]*\s*$", re.IGNORECASE)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def page_number(text: str) -> int | None:
    found = PAGE_NUMBER.fullmatch(unicodedata.normalize("NFKC", text))
    if not found:
        return None
    digits = found["number"].casefold()
    if digits.isdigit():
        return int(digits)
    values = [_ROMAN[c] for c in digits]
    return sum(-v if v < following else v for v, following in zip(values, [*values[1:], 0], strict=True))


def comparable(text: str) -> str:
    plain = unicodedata.normalize("NFKC", text).casefold().replace("ё", "е")
    return re.sub(r"\s+", " ", plain).strip(" \t\r\n-–—|·•")


def margin_lines(elements: DataFrame, material: str = "material", page: str = "page") -> DataFrame:
    """material, page, zone (header or footer), place (of the first element), text, image, x, y (centre): the lines of pages'
    margins. Pieces that stand beside each other are one line, images are lines of their own. Headings, elements of several
    lines, high ones and those without a whole box don't count.

    ``elements`` has material, page, id, kind, text, image (a hash, null without), x0, y0, x1, y1.
    """
    middle = (F.col("y0") + F.col("y1")) / 2
    zone = F.when(middle <= MARGIN, "header").when(middle >= 1 - MARGIN, "footer")
    inside = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        inside &= F.col(c).between(0, 1)
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = elements.where(inside & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("y1") - F.col("y0") <= HIGHEST))
    rows = rows.select(F.col(material).alias("material"), F.col(page).alias("page"), "id", "kind", text.alias("text"), "image", "x0", "y0", "x1", "y1", middle.alias("middle"), zone.alias("zone"))
    rows = rows.where(F.col("zone").isNotNull() & (F.coalesce("kind", F.lit("paragraph")) != "heading") & ~F.col("text").contains("\n"))
    is_image = F.coalesce(F.col("kind") == "image", F.lit(False))
    rows = rows.withColumn("lone", is_image).where(F.when(is_image, F.col("image").isNotNull()).otherwise(F.col("text") != ""))
    order = Window.partitionBy("material", "page", "zone", "lone").orderBy("middle", "x0", "id")
    beside = (F.col("middle") - F.lag("middle").over(order) <= LINE_DOWN) & (F.col("x0") - F.lag("x1").over(order) <= LINE_ACROSS) & ~F.col("lone")
    rows = rows.withColumn("line", F.sum(F.when(beside, 0).otherwise(1)).over(order)).withColumn("i", F.row_number().over(order))
    pieces = F.array_sort(F.collect_list(F.struct("i", "text")))
    joined = F.when(~F.col("lone"), F.trim(F.array_join(F.transform("pieces", lambda p: p["text"]), " ")))
    lines = rows.groupBy("material", "page", "zone", "lone", "line").agg(pieces.alias("pieces"), F.min("id").alias("place"), F.first("image").alias("image"),
                ((F.min("x0") + F.max("x1")) / 2).alias("x"), ((F.min("y0") + F.max("y1")) / 2).alias("y"))
    return lines.select("material", "page", "zone", "place", joined.alias("text"), F.when(F.col("lone"), F.col("image")).alias("image"), "x", "y")


class _Series:
    """Lines that are taken for the same one, known by the first of them."""

    def __init__(self, line, text: str, number: int | None):
        self.first, self.text, self.number, self.size = line, text, number, Counter(text)
        self.lines = [(line, number)]

    def takes(self, line, text: str, size: Counter, number: int | None) -> bool:
        f = self.first
        if abs(f.x - line.x) > NEAR or abs(f.y - line.y) > NEAR:
            return False
        if f.image is not None or line.image is not None:
            return f.image is not None and line.image is not None and (int(f.image) ^ int(line.image)).bit_count() <= BITS
        if self.number is not None or number is not None:
            return self.number is not None and number is not None
        both = len(self.text) + len(text)
        # Common characters bound the ratio from above, lengths bound those.
        if 2 * min(len(self.text), len(text)) < ALIKE * both or 2 * (self.size & size).total() < ALIKE * both:
            return False
        return SequenceMatcher(None, self.text, text).ratio() >= ALIKE


def _kept(series: _Series, least: int) -> list | None:
    """The lines of the pages that the series covers well enough: all pages, or those of one parity; whichever are most."""
    by_page = {line.page: (line, number) for line, number in series.lines}
    best = None
    for parity in (None, 0, 1):
        pages = sorted(p for p in by_page if parity is None or p % 2 == parity)
        if len(pages) >= least and len(pages) / ((pages[-1] - pages[0]) // (1 if parity is None else 2) + 1) >= COVERED and (best is None or len(pages) > len(best)):
            best = pages
    return best and [by_page[p] for p in best]


def running_series(lines: list, pages: int) -> list[dict]:
    """The running headers, footers and page numbers among one material's ``lines`` (in order; with page, zone, text, image, x,
    y), of which each joins the first series that takes it. Lines of a material of ``pages`` pages."""
    cells: dict[tuple, list[tuple[int, _Series]]] = {}
    every: list[_Series] = []
    for line in lines:
        text = comparable(line.text or "")
        number, size = page_number(line.text or "") if line.image is None else None, Counter(text)
        across, down = int(line.x // NEAR), int(line.y // NEAR)
        near = [s for dx in (-1, 0, 1) for dy in (-1, 0, 1) for s in cells.get((line.zone, across + dx, down + dy), ())]
        for _, series in sorted(near, key=lambda s: s[0]):
            if series.takes(line, text, size, number):
                series.lines.append((line, number))
                break
        else:
            every.append(_Series(line, text, number))
            cells.setdefault((line.zone, across, down), []).append((len(every), every[-1]))
    out = []
    for series in every if pages >= PAGES else ():
        kept = _kept(series, FEW if pages <= SHORT else MANY)
        if not kept:
            continue
        numbered = kept[0][1] is not None
        if numbered and Counter(n - line.page for line, n in kept).most_common(1)[0][1] < COVERED * len(kept):
            continue
        first = kept[0][0]
        out.append({"kind": "page_number" if numbered else first.zone, "element": "text" if first.image is None else "image", "text": series.text if first.image is None else None,
                    "pages": [line.page for line, _ in kept], "places": [line.place for line, _ in kept]})
    return out


def running_margins(elements: DataFrame, material: str = "material", page: str = "page") -> DataFrame:
    """material, kind (header, footer, page_number), element (text, image), text (of the series' first line, comparable), pages
    and places (of the lines' first elements): what a material's margins repeat.

    Only the lines of margins move; a material's lines are compared in one task, since each of them depends on the series that
    are there before it. Materials of fewer than PAGES pages have none.
    """
    lines = margin_lines(elements, material, page)
    count = elements.groupBy(F.col(material).alias("material")).agg(F.count_distinct(page).alias("n"))
    kinds = dict(lines.dtypes)

    def found(rows: list) -> Iterator[tuple]:
        for x in running_series(rows, rows[0].n):
            yield rows[0].material, x["kind"], x["element"], x["text"], x["pages"], x["places"]

    rows = lines.join(count, "material").withColumn("lone", F.col("image").isNotNull())
    schema = f"material {kinds['material']}, kind string, element string, text string, pages array<{kinds['page']}>, places array<{kinds['place']}>"
    return groups.over(rows, ["material"], ["page", F.desc("lone"), F.desc("zone"), "y", "x", "place"], found, schema)


# How near a page's upper or lower edge an image's centre is in a margin, the share of a page from which it fills
# the page, pages with the same image that make a repetition.
IMAGE_MARGIN, PAGE_SIZED, REPEATS = 0.12, 0.7, 2


def image_signals(images: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """``images`` (material, page, id, digest, x0, y0, x1, y1, width, height in pixels, caption) with area, side, repeated, margin,
    page_sized, small_area, header_footer and role (as ``structure.image_role`` says).

    An image repeats where REPEATS pages of its material have its digest, or where it belongs to a series of its margins
    (``series``, of ``running_margins``). Pages are counted by digest before they meet images, so an ornament on every page is
    one row a material. Without a box, size and place say nothing; without a digest, an image is missing and unknown.
    """
    digests = images.where("digest IS NOT NULL").select("material", "page", "digest").distinct().groupBy("material", "digest").agg(F.count(F.lit(1)).alias("_pages"))
    area, middle = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), (F.col("y0") + F.col("y1")) / 2
    rows = images.join(digests, ["material", "digest"], "left").withColumn("area", area).withColumn("side", F.least("width", "height"))
    if series is not None:
        held = series.where("element = 'image'").select("material", F.explode(F.arrays_zip("pages", "places")).alias("_s")).select("material", F.col("_s.pages").alias("page"), F.col("_s.places").alias("id"), F.lit(True).alias("header_footer")).distinct()
        rows = rows.join(held, ["material", "page", "id"], "left")
    else:
        rows = rows.withColumn("header_footer", F.lit(None).cast("boolean"))
    no = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumn("header_footer", no(F.col("header_footer"))).withColumn("repeated", no(F.col("_pages") >= REPEATS) | F.col("header_footer"))
    rows = rows.withColumn("margin", no((middle <= IMAGE_MARGIN) | (middle >= 1 - IMAGE_MARGIN))).withColumn("page_sized", no(F.col("area") >= PAGE_SIZED)).withColumn("small_area", no(F.col("area") < structure.SMALL_AREA))
    role = structure.image_role(F.col("side"), F.col("area"), F.col("repeated"), F.col("margin") | F.col("header_footer"), no(F.col("caption") != ""), F.col("page_sized"))
    whole = F.when(F.col("digest").isNull() & (role == "content"), "unknown").otherwise(role)
    return rows.select(*images.columns, "area", "side", "repeated", "margin", "page_sized", "small_area", "header_footer", whole.alias("role"))
