"""Numbered lists, imports, highlights, evidence, ranges, packets and free time on made-up rows."""

import datetime as dt
import random
import re
from collections import Counter
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from quillwork.functions import vectorised as V
from quillwork.operators import evidence as E
from quillwork.operators import planning as P
from quillwork.operators import ranges as G
from quillwork.operators import series as N
from quillwork.operators import trees as R


def selection(spark, lines, expected=None):
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate(lines)], "key string, pos int, line string")
    chosen, items = N.selected(rows, spark.createDataFrame([("k", expected)], "key string, expected int"))
    (c,) = chosen.collect() or [None]
    return c, [(r.number, r.text) for r in items.sort("pos").collect()]


def test_longest_list_with_continuation_lines(spark):
    c, items = selection(spark, ["Program", "1. one", "", "  more of one ", "2) two", "3 three", "3.1 not an item", "1. again", "2. twice", "end"])
    assert items == [(1, "one more of one"), (2, "two"), (3, "three 3.1 not an item")]
    assert (c.how, c.ambiguous, c["items"], c.parts, c.before, c.after, c.gap, c["first"], c["last"], c.source_end) == ("longest", False, 3, 1, 1, 3, 0, 1, 3, 6)


def test_expected_numbers_choose_exact_then_stitched_then_longest(spark):
    lines = ["1. a", "2. b", "4. d", "5. e", "6. f", "1. x", "8. h"]
    assert [x[0] for x in selection(spark, lines, 3)[1]] == [4, 5, 6]
    c, items = selection(spark, lines, 6)
    assert (c.how, c["items"], c.parts, c.dropped, c.gap) == ("stitched", 6, 3, 1, 1) and [n for n, _ in items] == [1, 2, 4, 5, 6, 8]
    c, items = selection(spark, ["5. a", "6. b", "1. c", "2. d", "3. e"], 9)
    assert (c.how, c.ambiguous) == ("longest", False) and [n for n, _ in items] == [1, 2, 3]
    c, items = selection(spark, ["1. a", "2. b", "1. c", "2. d"])
    assert c.ambiguous and items == [] and (c["items"], c.parts, c["first"], c.source_end) == (0, 0, None, None)
    assert selection(spark, ["1. a", "2. b", "1. c", "2. d"], 2)[0].ambiguous
    assert selection(spark, ["no", "numbers", ""]) == (None, [])


def test_reach_of_graphs_with_cycles(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(75)) for _ in range(90)] + [(0, 0), (1, 2), (2, 1)]
    files, roots = set(range(66)), {0, 1, 70}
    depth, front = {r: 0 for r in roots & files}, roots & files
    while front:
        front = {d for s, d in edges if s in front and d in files and d not in depth}
        depth |= {x: 1 + max(depth.values()) for x in front}
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = R.reachable(make(edges, "src int, dst int"), make([(r,) for r in roots], "id int"), make([(f,) for f in files], "id int")).collect()
    assert {r.id: r.depth for r in got} == depth and len(got) == len(depth)
    assert R.reachable(make(edges, "src int, dst int"), make([], "id int"), make([(1,)], "id int")).collect() == []


def test_highlights_keep_the_text_as_it_is(spark):
    text = "😀 Ёлка, ёлки и ЕЛКА; red-Redder"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select("t", V.highlights(F.col("t"), ["елка"], "red").alias("h"))
    rows = df.select("t", "h", V.surface_forms(F.col("h")).alias("f")).collect()
    assert [text[x.start : x.end] for x in rows[0].h] == ["Ёлка", "ЕЛКА", "red", "Redder"] and rows[0].f == ["Ёлка", "red", "Redder"]
    assert [(r.h, r.f) for r in rows[1:]] == [([], []), ([], [])]


def test_evidence_ladder(spark):
    units = [("a", "The sum $\\alpha \\le \\beta$ of two sets is a set."), ("b", "Every bounded sequence has a limit point, says the theorem we prove today."), ("c", "Short."), ("d", None), ("e", "СЕТЬ of nets"), ("f", "every bounded sequence HAS a limit point")]
    asked = [(1, "a", "of two sets"), (2, "a", "sum α ≤ β of"), (3, "b", "every bounded sequence has one limit point says"), (4, "b", "none of these words are there"), (5, "a", "bounded sequence has"), (6, "e", "CETЬ"), (7, "c", ""), (8, "d", "x"), (9, "zz", "short."), (10, "b", None), (11, "c", "of nets"), (12, "c", "*"), (13, "a", "set a set")]
    got = {r.id: (r.found, r.how, r.start, r.end) for r in E.repaired(spark.createDataFrame(asked, "id int, ref string, quote string"), spark.createDataFrame(units, "ref string, text string")).collect()}
    text = dict(units)
    assert got[1][:2] == ("a", "exact") and text["a"][got[1][2] : got[1][3]] == "of two sets"
    assert got[2] == ("a", "normalized", 0, len(text["a"])) and got[6][:2] == ("e", "normalized")
    assert got[3][:2] == ("b", "approximate") and text["b"][got[3][2] : got[3][3]] == "Every bounded sequence has a limit point, says"
    assert got[5][:2] == ("b", "ref_corrected") and got[11][:2] == ("e", "ref_corrected") and got[9][:2] == ("c", "ref_corrected")
    assert got[7] == ("c", "exact", 0, 6) and {got[i] for i in (4, 8, 10, 12, 13)} == {(None, "lost", None, None)} and len(got) == 13


def test_best_window_is_the_best_of_all():
    rng = random.Random(6)
    for _ in range(200):
        text, quote = ([rng.choice("abcdé") * 2 for _ in range(rng.randrange(1, 14))] for _ in range(2))
        quote = quote[: rng.randrange(1, 6)]
        share, start, end = E.window(", ".join(text), " ".join(quote))
        n = len(quote)
        best = max(sum((Counter(text[i : i + n]) & Counter(quote)).values()) for i in range(max(1, len(text) - n + 1)))
        assert round(share * n) == best and (not best or sum((Counter(", ".join(text)[start:end].split(", ")) & Counter(quote)).values()) == best)


def test_ranges_begin_and_end_at_headings(spark):
    fr = [("k", p, i, t, h, lv, c) for p, i, t, h, lv, c in [
        (1, 0, "preface", False, None, True), (1, 1, "header", False, None, False), (1, 2, "One  ", True, 1, True), (1, 3, "text", False, None, True), (1, 4, "Two", True, 2, True),
        (2, 0, "more", False, None, True), (2, 1, "Deep", True, 3, True), (2, 2, "Other", True, 1, True), (3, 0, "noise", True, 1, False), (5, 0, "x", False, None, True)]]
    topics = [("k", 1, "ONE", 1, 1, "two", 1, None), ("k", 2, "two", 1, 1, "not there", 2, None), ("k", 3, "absent", 2, 2, "x", 3, None), ("k", 4, "Other", 2, 3, "y", 4, None), ("k", 5, "Other", 2, 4, "z", 5, 4), ("k", 6, "Deep", 2, 4, "z", 5, 9), ("k", 7, "One", 1, 4, None, None, None), ("k", 8, "one", 1, 2, "q", 7, None)]
    df = spark.createDataFrame(fr, "key string, page int, place int, text string, heading boolean, level int, content boolean")
    r = G.refined(spark.createDataFrame(topics, "key string, ord int, title string, page_from int, page_to int, next_title string, next_page int, page_count int"), df)
    got = {x.ord: (tuple(x.start), tuple(x.end)) for x in r.collect()}
    assert got == {1: ((1, 1), (1, 4)), 2: ((1, 4), (2, 2)), 3: ((2, 0), (3, 0)), 4: ((2, 2), (5, 0)), 5: ((2, 2), (5, 0)), 6: ((2, 1), (6, 0)), 7: ((1, 1), (5, 0)), 8: ((1, 1), (3, 0))}
    parts = spark.createDataFrame([("k", 7, 1, "two", 1), ("k", 7, 2, "nowhere", 2), ("k", 7, 3, "other", 2), ("k", 7, 4, "one", 1), ("k", 7, 5, "late", 9), ("k", 7, 6, "before", 0)], "key string, ord int, part int, title string, page_from int")
    rows = sorted((x.part or 0, x.page_from, x.place_from, x.page_to, x.place_to) for x in G.split_by_parts(r.where("ord = 7"), parts, df).collect())
    # "one" stands before the range's own heading ends, so it has its page only, and cuts don't go back.
    assert rows == [(0, 1, 1, 1, 4), (1, None, None, None, None), (2, 2, 0, 2, 2), (3, 2, 2, 4, 0), (4, 1, 4, 1, 0)]


def plain_packets(units, budget):
    """One section: (order, text) in order; sentence by sentence, a packet at a time."""
    out, packet, used, last = [], 0, 0, None
    for o, text in units:
        stops = [0, *(m.end() for m in re.finditer(r"\n\s*\n|(?<=[.!?])\s+", text)), len(text)]
        todo = [(a, b) for a, b in zip(stops, stops[1:], strict=False) if b > a] if P.estimated_tokens(text) > budget else [(0, len(text))]
        pieces, held = [], None
        for a, b in todo:
            n = P.estimated_tokens(text[a:b])
            if n > budget:
                pieces += [(*held, False)] if held else []
                held, width = None, -(-(b - a) // -(-n // budget))
                while a < b:
                    pieces.append((a, min(b, a + width), True))
                    a += width
            elif held and P.estimated_tokens(text[held[0] : b]) > budget:
                pieces.append((*held, False))
                held = (a, b)
            else:
                held = (held[0] if held else a, b)
        pieces += [(*held, False)] if held else []
        for a, b, forced in pieces:
            n = P.estimated_tokens(text[a:b])
            if used and (used + n > budget or last == o):
                packet, used = packet + 1, 0
            out.append((o, packet, a, b, n, forced))
            used, last = used + n, o
    return out


def test_packets_of_sentences_and_forced_slices(spark):
    rng = random.Random(8)
    rows = []
    for k in range(12):
        for o in range(rng.randrange(1, 7)):
            text = "".join("".join(rng.choice(["ab ", "c, ", "d! "]) for _ in range(rng.randrange(1, 30))).strip() + rng.choice([". ", "? ", "\n\n", ".\n"]) for _ in range(rng.randrange(6)))
            rows.append((k, o, text))
    rows += [(99, 0, "w " * 500), (99, 1, None), (99, 2, ""), (99, 3, "e" * 5000 + ". f")]
    got = {}
    for r in P.packets(spark.createDataFrame(rows, "k int, o int, t string"), "k", "o", "t", 25).collect():
        got.setdefault(r.k, []).append((r.o, r.packet, r.start, r.end, r.tokens, r.forced))
    for k in {r[0] for r in rows}:
        assert sorted(got[k]) == sorted(plain_packets([(o, t or "") for kk, o, t in rows if kk == k], 25))
    assert any(x[5] for v in got.values() for x in v)


def test_free_time_against_the_clock(spark):
    """Minute by minute, with Python's own time zones."""
    rng = random.Random(9)
    rows = []
    for i in range(40):
        zone = rng.choice(["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "UTC"])
        day = rng.choice([dt.date(2024, 3, 30), dt.date(2024, 3, 31), dt.date(2024, 4, 6), dt.date(2024, 4, 7), dt.date(2024, 10, 27), dt.date(2024, 11, 3), dt.date(2024, 7, 1)])
        time = lambda: rng.randrange(0, 1440, 30)
        busy = [(rng.choice([None, None, day.weekday()]), rng.choice([None, None, day, day + dt.timedelta(1)]), time(), time()) for _ in range(rng.randrange(4))]
        deadline = rng.choice([None, day, day + dt.timedelta(1)])
        rows.append((i, zone, rng.choice([0, 240, 300]), (time(), time()), busy, deadline, rng.choice([None, time()]) if deadline else None, rng.randrange(200), rng.random() < 0.5, 10_000, {}, {}, [], 1.0, 0, None, day))
    window = "struct<weekday:int,on_date:date,from:int,to:int>"
    schema = f"i int, zone string, boundary int, sleep struct<from:int,to:int>, busy array<{window}>, deadline date, exam_time int, exam_reserve int, exam_day_enabled boolean, daily_minutes int, weekday_minutes map<int,int>, date_minutes map<date,int>, rest_dates array<date>, final_day_ratio double, used_seconds int, now timestamp_ntz, on_date date"
    got = {r.i: r.free for r in P.free_minutes(spark.createDataFrame(rows, schema)).collect()}
    for i, zone, boundary, sleep, busy, deadline, exam, reserve, exam_day, *_, day in rows:
        at = lambda d, m: dt.datetime.combine(d, dt.time(m // 60, m % 60), ZoneInfo(zone)).astimezone(dt.UTC)  # noqa: B023, E731
        left, right = at(day, boundary), at(day + dt.timedelta(1), boundary)
        if deadline and exam is not None:
            right = min(right, at(deadline, exam) - dt.timedelta(minutes=reserve))
        if deadline and (exam is None or not exam_day):
            right = min(right, at(deadline, 0))
        spans = []
        for off in (-1, 0, 1):
            d = day + dt.timedelta(off)
            for wd, on, a, z in [(None, None, *sleep), *busy]:
                if (on == d) if on else (wd is None or wd == d.weekday()):
                    spans.append((at(d, a), at(d + dt.timedelta(z <= a), z)))
        free, t = 0, left
        while t < right:
            free += not any(a <= t < z for a, z in spans)
            t += dt.timedelta(minutes=1)
        assert got[i] == free, rows[i]
