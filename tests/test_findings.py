"""What the findings of round 3 named, on small inputs."""

import datetime as dt
import re
import unicodedata

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillwork.functions import groups
from quillwork.functions import text as X
from quillwork.functions import vectorised as V
from quillwork.operators import chunking as C
from quillwork.operators import evidence as E
from quillwork.operators import geometry as G
from quillwork.operators import planning as P
from quillwork.operators import postings as P2
from quillwork.operators import relational as R2
from quillwork.operators import retrieval as Q2
from quillwork.operators import structure as S
from quillwork.sources import shared


def copied(folder, **changed):
    """A folder with these tables."""
    for name, df in changed.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_duplicate_titles_make_no_pairs(spark):
    nodes = spark.range(20000).select(F.col("id").alias("node"), F.when(F.col("id") % 2 == 0, "Ring").otherwise("rING").alias("title"))
    sections = nodes.where("node % 4 = 0").select((F.col("node") + 7).alias("section"), "node")
    got = S.title_totals(sections, nodes, "section", "node", "title", {"nodes": F.count(F.lit(1)), "total": F.sum("node")})
    assert [tuple(r) for r in got.groupBy("nodes", "total").count().collect()] == [(20000, 199990000, 5000)]
    few = S.title_totals(sections.limit(40), nodes.where("node < 160"), "section", "node", "title", {"n": F.count(F.lit(1)), "first": F.min("node")})
    pairs = S.title_fan_out(sections.limit(40), nodes.where("node < 160"), "section", "node", "title")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, pairs.groupBy("section").agg(F.count(F.lit(1)), F.min("node")).collect()))


def test_capitals_keep_the_length(spark):
    df = spark.createDataFrame([("Straße ñé",), (None,)], "x string")
    assert [tuple(r) for r in df.select(X.capitals(F.col("x")).alias("u"), F.lower(X.capitals(F.col("x"))).alias("l")).collect()] == [("STRAẞE ÑÉ", "straße ñé"), (None, None)]


def test_evidence_with_sharp_s_is_found(spark, tmp_path):
    from quillwork.plans.documents import evidence_repair

    text = "wir gehen heute auf der großen Straße nach Hause und schließen die Tür"
    d = copied(tmp_path, benchmark=spark.createDataFrame([(1, text)], "item_id long, text string"), documents=spark.createDataFrame([(5, f"Also {text} ab."), (9, text)], "doc_id long, text string"))
    assert [tuple(r) for r in evidence_repair(spark, d).collect()] == [(1, 5, "normalized")]


def test_reindexed_capitals_keep_the_length(spark, tmp_path):
    from quillwork.plans.streams import incremental_reindex

    d = copied(tmp_path, documents=spark.createDataFrame([(1, "fr", "Straße"), (2, "de", "Straße")], "doc_id long, lang string, text string"))
    assert sorted(map(tuple, incremental_reindex(spark, d).collect())) == [("de", 1, 6), ("fr", 1, 6)]


def test_forecast_goes_on_beyond_two_years(spark):
    lessons = spark.createDataFrame([("a", i, i, 60, True, False) for i in range(1000)], "key string, id int, ord int, minutes int, eligible boolean, completed boolean")
    plan = spark.createDataFrame([], "key string, id int, on_date date, minutes int")
    got = P.finish_forecast(lessons, plan, "key", dt.date(2024, 5, 1), 60, 7).collect()
    assert [tuple(r) for r in got] == [("a", 1000, dt.date(2024, 5, 1) + dt.timedelta(999))]
    assert P.lesson_plan(lessons, plan, "key", dt.date(2024, 5, 1), 60, 7).count() == P.MAX_DAYS


def test_groups_in_order_whatever_the_batches(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k"), "id")
    got = groups.over(df, ["k"], [F.desc("id")], lambda rows: [(rows[0].k, len(rows), [r.id for r in rows[:2]])], "k long, n int, first array<long>")
    want = {k: [i for i in range(49_999, -1, -1) if (i % 7 or None) == k] for k in (None, *range(1, 7))}
    assert {r.k: (r.n, r.first) for r in got.collect()} == {k: (len(v), v[:2]) for k, v in want.items()}
    assert groups.over(df.where("id < 0"), ["k"], ["id"], lambda rows: [(1,)], "n int").collect() == []


def test_running_images_by_all_bits_of_their_hashes(spark):
    rows = [("m", p, 0, "image", None, (1 << 60) + (1023 if p % 2 else 0), 0.4, 0.02, 0.5, 0.05) for p in range(1, 21)]
    rows += [("m", p, 1, "paragraph", f"{'abcdefghijklmnopqrst'[p - 1] * 9}", None, 0.1, 0.95, 0.2, 0.97) for p in range(1, 21)]
    df = spark.createDataFrame(rows, "material string, page int, id int, kind string, text string, image long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.element, r.pages) for r in G.running_margins(df).collect())
    assert got == [("image", list(range(1, 21, 2))), ("image", list(range(2, 21, 2)))]


def test_bounded_heading_scores_are_the_whole_ones_from_the_bar_on():
    titles = [f"{a} {b} of brand {n} supply and {c}" for a in ("large", "hot") for b in ("ring", "bolt") for n in (7, 16) for c in ("demand", "pricing", "storage")]
    others = [*titles, *(t.replace("o", "0") for t in titles), *(f"the answer says {n} and goes on for a while" for n in range(9)), "", "x"]
    pairs = [(a, a.split(), b, list(dict.fromkeys(b.split()))) for a in others for b in titles]
    whole, bounded = [V.score_headings(*p) for p in pairs], [V.score_headings(*p, 0.45) for p in pairs]
    assert all(x == y or (x < 0.45 and y == 0) for x, y in zip(whole, bounded, strict=True))
    assert sum(x > 0 and y == 0 for x, y in zip(whole, bounded, strict=True)) > 100


def test_postings_are_shuffled_once(spark):
    index = P2.Index(spark, shared.folder(spark, "index-test"), 8, 3)
    texts = spark.createDataFrame([(1, "a b a c"), (2, None), (3, ""), (4, "c c")], "id long, text string")
    postings, _ = index._rows(texts)
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.id, r.term, r.tf, r.length, list(r.places)) for r in postings.collect())
    assert got == [(1, "a", 2, 4, [0, 2]), (1, "b", 1, 4, [1]), (1, "c", 1, 4, [3]), (4, "c", 2, 2, [0, 1])]


def test_batches_hold_no_key_whole(spark):
    rows = spark.range(30000).select(F.lit("k").alias("k"), "id", F.lit(10).alias("n"))
    got = P.batches(rows, "k", "id", "n", 100)
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.groupBy("batch").count().groupBy("count").count().collect()] == [(10, 3000)]
    assert got.where("batch <> id div 10").count() == 0


def test_division_makes_no_parts_by_the_few(spark, tmp_path):
    links = spark.range(3000).select((F.col("id") / 3).cast("long").alias("item"), (F.col("id") % 3).alias("n")).where("item % 2 = 0 OR n < 2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = R2.divided(links, "item", "n", links.where("n <= 3"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [n" not in plan and "hashpartitioning(n#" not in plan.split("BroadcastExchange")[0]
        assert sorted(r.item for r in got.collect()) == list(range(0, 1000, 2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tokens_are_objects_a_few_texts_at_a_time(spark, monkeypatch):
    rows = [(i, None if i % 50 == 7 else "" if i % 50 == 8 else "Ёлка one, two two " + "x" * (i % 5)) for i in range(150)]
    df = spark.createDataFrame(rows, "i long, t string").coalesce(1)
    got = df.select("i", V.token_positions(F.col("t")).alias("p"), V.frequent_terms(F.col("t"), F.lit("one"), 3, 2).alias("n")).collect()
    assert len(got) == 150 and V.TEXTS < 150
    for r in got:
        text = rows[r.i][1] or ""
        assert [(t.token, text[t.start : t.end]) for t in r.p][:2] == ([("елка", "Ёлка"), ("one", "one")] if text else [])
        assert [tuple(t) for t in r.n] == ([("two", 2), ("xxx" if r.i % 5 == 3 else "xxxx" if r.i % 5 == 4 else "елка", 1)] if text else [])


def test_memory_stream_is_called_by_learner(spark, tmp_path):
    from quillwork.streaming import twins

    # Two batches (one file each); a learner's nodes are one call's.
    rows = [[(s, n, d, d * 100 + (n or 0), 1 + (s + (n or 0) + d) % 5) for s in (1, 2) for n in (None, 3, 4) for d in days] for days in ((1, 2, 9), (2, 9, 20, 40))]
    schema = "session long, node int, day long, id long, quality int"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append" if i else "errorifexists").parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/t")
    model = twins.memory(stream, ["session", "node"])
    assert ", ['session], [" in model._jdf.queryExecution().logical().toString()
    got = twins.drained(model, ["session", "node"]).collect()
    assert len(got) == 6
    for r in got:
        reps, interval, ease, last, n, due = 0, 0, 2.5, None, 0, 0
        for part in rows:
            for s, node, day, _, q in part:
                if (s, node) == (r.session, r.node) and day != last:
                    before, last, n = ease, day, n + 1
                    ease = max(1.3, ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
                    interval = 1 if q < 3 or reps == 0 else 6 if reps == 1 else int(-(-interval * before // 1))
                    reps, due = (reps + 1 if q >= 3 else 0), day + interval
        assert (r.grades, r.reps, r.interval, r.due) == (n, reps, interval, due)


def test_evidence_elsewhere_makes_few_pairs(spark, monkeypatch):
    # Words are few, so each is in many units; texts are all different, but one that stands three times.
    text = lambda i: " ".join("abcdefgh"[(i * 7919 >> (2 * j)) % 8] + "xyz"[(i >> j) % 3] for j in range(14))
    units = [(i, text(i % 398 if i >= 398 else i)) for i in range(400)] + [(400, text(0))]
    evidence = [(i, i + 1, " ".join(units[i][1].split()[1:12])) for i in range(0, 300, 3)] + [(900, 0, "no such words are anywhere in it"), (901, 0, "dx"), (902, 5, "nosuch dx")]
    got = {r.id: (r.found, r.how) for r in E.repaired(spark.createDataFrame(evidence, "id long, ref long, quote string"), spark.createDataFrame(units, "ref long, text string")).collect()}
    for i, ref, quote in evidence:
        own = dict(units)[ref]
        if got[i][1] in ("lost", "ref_corrected"):
            want = min((r for r, t in units if r != ref and E.plain(quote) in E.plain(t)), default=None)
            assert got[i] == ((want, "ref_corrected") if want is not None else (None, "lost"))
        else:
            assert E.plain(quote) in E.plain(own) or got[i][1] == "approximate"
    assert got[0] == (0, "ref_corrected")
    # A quotation's run is among the runs of any text that has it.
    for i in range(0, 400, 5):
        ws = units[i][1].split()
        for a in range(4):
            for n in range(1, len(ws) - a):
                for v in E.LEVELS:
                    if max(1, 3 * v - 1) <= n:
                        assert E.runs(ws[a : a + max(1, 3 * v - 1)], v)[0] in E.runs(ws, v)
    assert len(E.runs(units[1][1].split(), 3)) <= 9


def test_strings_meet_texts_by_an_inner_word(spark):
    texts = ["the red house on", "red", "a reddish house", "THE RED house on", "x-house-y", "", None, "die ёлка ist", "елка ist"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    strings = ["the red house on", "red", "e red h", "-house-", "", "die ёлка i", "house", "nowhere to be found"]
    got = Q2.containing(docs, spark.createDataFrame(list(enumerate(strings)), "q long, s string"), "id", "text", "q", "s")
    assert sorted((r.id, r.q) for r in got.collect()) == sorted((i, q) for i, t in enumerate(texts) for q, s in enumerate(strings) if t is not None and s in t)
    keyed = spark.createDataFrame([(0, "e red h")], "q long, s string")
    plan = Q2.containing(docs, keyed, "id", "text", "q", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan


def test_exam_lists_make_their_texts_once(spark, sf_dir):
    from quillwork.plans.materials import exam_lists

    assert "lineitem" not in exam_lists(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_exam_lists_number_lines_in_their_row_and_make_nodes_once(spark):
    from quillwork.operators import exams as Q3

    texts = spark.createDataFrame([(1, "1. A\n\n 1.1 x \n2. B. 3. C"), (2, "— a\nb"), (3, None)], "key long, text string")
    rows = Q3.lines(texts)
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "1. A"), (1, 1, "1.1 x"), (1, 2, "2. B."), (1, 3, "3. C"), (2, 0, "— a"), (2, 1, "b")]
    nodes, reports = Q3.exam_list(texts)
    for df in (nodes, reports, *Q3.tickets(texts)):
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.key, r.title) for r in nodes.collect()) == [(1, "A"), (1, "B."), (1, "C"), (1, "x"), (2, "a b")]
    assert sorted((r.key, r.error, r.questions, r.parts) for r in reports.collect()) == [(1, None, 3, 1), (2, None, 1, 0), (3, "empty", 0, 0)]


def test_exam_texts_number_orders_not_lines(spark, sf_dir):
    from quillwork.plans import materials

    plan = materials._exam_texts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "explode" not in plan


def test_pieces_count_each_token_once(monkeypatch):
    seen = []
    counted = C.COUNTED
    monkeypatch.setattr(C, "COUNTED", type("", (), {"findall": lambda _, t: seen.append(len(t)) or counted.findall(t)})())
    text = " ".join(f"w{i}" for i in range(20_000))
    found = C.pieces_of(text, 150)
    assert " ".join(t for t, _ in found) == text and all(n == len(t.split()) <= 150 for t, n in found)
    assert sum(seen) <= 3 * len(text)


def test_sections_are_packed_without_a_data_frame_a_document(spark):
    rows = [(k, p, f"line {p} of {k}, " * (1 + p % 40) if p % 3 else f"Head {p}", p // 3, p % 3 == 0, str(p // 50), p // 40, p % 5) for k in range(5) for p in range(90)]
    lines = spark.createDataFrame(rows, "k long, pos int, line string, section long, heading boolean, group string, page long, quality int")
    got = C.packed_sections(lines, "k", C.Bounds(40, 60, 5), also=("page", "quality"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "Join" not in plan
    assert {(r.k, r.pos, r.page, r.quality) for r in got.collect()} == {(r[0], r[1], r[6], r[7]) for r in rows}


def test_sections_are_dealt_out_as_documents(spark, sf_dir):
    from quillwork.plans import documents

    lines = documents._sections(spark, sf_dir)
    plan = C.packed_sections(lines, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert lines.select("doc_id", "pos", "section").subtract(documents._headed(spark, sf_dir).select("doc_id", "pos", F.sum(F.col("heading").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos")))).count() == 0


def test_drafts_put_pieces_together_once(spark):
    pieces = [(1, 0, o, p, p // 2, p == 0, t, 2, 1, 0) for o, (p, t) in enumerate([(0, "  "), (0, ""), (1, " a b "), (1, "c d"), (2, ""), (3, "e f")])]
    sections = spark.createDataFrame([(1, 0, "T", None), (1, 1, "U", 0)], "k long, section long, title string, parent long")
    d = C.drafts(spark.createDataFrame(pieces, "k long, chunk int, ord int, pos int, section long, heading boolean, text string, tokens int, page long, quality int"), sections, "k", F.lit("doc"))
    r = d.collect()[0]
    assert (r.text, r.section, r.title, r.blocks, r.line_from, r.line_to) == ("a b c d\n\n\n\ne f", 0, "T", [0, 1], 0, 3)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # titles of parents, and titles of chunks


def test_free_minutes_use_all_cores(spark, sf_dir):
    from quillwork.plans.materials import free_minutes

    assert free_minutes(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_headings_are_compared_only_where_bounds_allow(spark, monkeypatch):
    made = []
    matcher = V.difflib.SequenceMatcher
    monkeypatch.setattr(V.difflib, "SequenceMatcher", lambda *x, **y: made.append(x) or matcher(*x, **y))
    a, b = "the history of the northern harbour and trade", "some notes on a theory of sets and numbers too"
    assert V.score_headings(a, list(dict.fromkeys(a.split())), b, b.split(), 0.45) == 0.0 and not made
    names = ["".join("abcde"[(i * 7 + j * j) % 5] for j in range(2 + i % 6)) for i in range(60)]
    for i in range(400):
        s = list(dict.fromkeys(names[(i * 3 + j) % 60] for j in range(1 + i % 5)))
        t = [w[:-1] + "f" if (i + j) % 3 == 0 else w for j, w in enumerate(s)][: 1 + i % 4]
        full = V.score_headings(" ".join(s), s, " ".join(t), t)
        for least in (0.45, 0.7, 0.9):
            got = V.score_headings(" ".join(s), s, " ".join(t), t, least)
            assert got == full if full >= least else got < least
    left, right = spark.createDataFrame([(1, "one two")], "title_id long, title string"), spark.createDataFrame([(1, "one three")], "heading_id long, heading string").coalesce(1)
    assert "RepartitionByExpression" in S.heading_matches(left, right)._jdf.queryExecution().optimizedPlan().toString()


def test_bounds_of_words_hold():
    import pyarrow as pa

    names = ["".join("abcde"[(i * 7 + j * j) % 5] for j in range(1 + i % 7)) for i in range(60)]
    s = [list(dict.fromkeys(names[(i * 3 + j) % 60] for j in range(i % 6))) for i in range(200)]
    t = [[w[:-1] + "f" if (i + j) % 3 == 0 else w for j, w in enumerate(x)][: i % 5] for i, x in enumerate(s)]
    for x, y, bound in zip(s, t, V._words_bound(pa.array(s, pa.list_(pa.string())), pa.array(t, pa.list_(pa.string()))), strict=True):
        shared = sum(V._partners(x, y, 0.8))
        assert not x or shared / (len(x) + len(y) - shared) <= bound + 1e-9
    assert V._words_bound(pa.array([["northern", "the"]]), pa.array([["quick", "fox"]])).tolist() == [0.0]


def test_evidence_is_looked_for_in_few_units(spark):
    # Each text has 30 runs of its own; of 500 texts three have the one that is looked for.
    rng = np.random.default_rng(7)
    said = [" ".join(f"w{x}" for x in rng.integers(0, 40, 30)) for _ in range(500)]
    said[7] = said[200] = f"x {said[400]} y"
    quote = " ".join(said[400].split()[3:16])
    units = spark.createDataFrame([*enumerate(said), (500, None), (501, "")], "ref long, text string")
    rows = E.holding(units, spark.createDataFrame([(r["level"], r["hash"]) for r in E.chosen([quote])], "level int, hash long"))
    assert {r.ref for r in rows.collect()} == {7, 200, 400} and rows.count() == 3
    assert E.holding(units, spark.createDataFrame([], "level int, hash long")).count() == 0


def test_texts_are_compared_in_bulk_as_one_by_one():
    rng = np.random.default_rng(5)
    pieces = ["a", "Ж", "é", "e\u0301", "\u0301", " ", "  ", "\t", "...", "…", "--", "-—", "-", "\\alpha", "\\(", "\\)", "\\", "$", "{", "*", "_", "x_1", "½", "ﬁ", "ß", "İ", "\u2028", "\x1f", "12", "Σ"]

    def one(text):
        s = re.sub(r"\\([a-zA-Z]+)", lambda m: E.COMMANDS.get(m[1], m[1]), unicodedata.normalize("NFKC", text))
        s = re.sub(r"\.{2,}|…|[-—]{2,}", " ", re.sub(r"\\[()\[\]]|\$|[{}*_`]", "", s))
        return " ".join(s.translate(E.LOOKALIKES).casefold().split())

    texts = ["".join(rng.choice(pieces, rng.integers(0, 14))) for _ in range(3000)]
    assert E.plains(texts) == [*map(one, texts)] == [*map(E.plain, texts)] and E.plains([]) == []
    assert E.plains(["a\0B", "\0", "c"]) == ["а\0в", "\0", "с"]
    # Words are those of the expression, and a quotation's run is one of its runs.
    words, row = E.marks(texts)
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"\w+", t)]
    assert [i for i, _ in want] == row.tolist() and len({*zip((w for _, w in want), words.tolist(), strict=True)}) == len({w for _, w in want}) == len({*words.tolist()})
    for t, r in zip(texts, E.chosen(texts), strict=True):
        inner = re.findall(r"\w+", t)[1:-1]
        assert (r is None) == (not inner) and (r is None or r["hash"] == E.runs(inner[: max(1, 3 * r["level"] - 1)], r["level"])[0])
