"""Small cases with known answers."""

import math
import re
import time
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.functions import arrays as A
from quillwork.functions import text as X
from quillwork.functions import vectorised as V
from quillwork.operators import alignment as A2
from quillwork.operators import chunking as C
from quillwork.operators import grading as G
from quillwork.operators import memory as M
from quillwork.operators import planning as P
from quillwork.operators import retrieval as Q
from quillwork.operators import structure as S
from quillwork.operators import timeline as L
from quillwork.operators import trees
from quillwork.sources import files, html, sinks


def values(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).head())


def test_memory_intervals(spark):
    rows = [("a", d, d, 4) for d in (1, 2, 8)] + [("b", 1, 1, 5), ("b", 2, 2, 2), ("b", 2, 3, 5), ("c", 1, 1, 3)]
    got = {r.k: r for r in M.replay(spark.createDataFrame(rows, "k string, day int, id int, quality int"), ["k"]).collect()}
    assert (got["a"].interval, got["a"].reps, got["a"].due) == (15, 3, 23)  # 1, 6, ceil(6 * 2.5)
    assert (got["b"].interval, got["b"].reps, got["b"].grades) == (1, 0, 2)  # a day's second grade doesn't count
    assert got["c"].ease == pytest.approx(2.36)


def test_wilson(spark):
    low, high = values(spark, *M.wilson(F.lit(10), F.lit(10)))
    assert high == pytest.approx(1.0) and low == pytest.approx(0.7225, abs=1e-3)
    assert values(spark, *M.wilson(F.lit(0), F.lit(0)))[0] in (None, 0.0)


def test_intervals(spark):
    df = spark.createDataFrame([(1, "s", 0, 10), (2, "s", 5, 8), (3, "s", 9, 20), (4, "s", 30, 30)], "id int, s string, start int, end int")
    assert L.union_seconds(df, ["s"]).head().seconds == 20
    assert sorted((r.id, r["from"]) for r in L.clipped(df, ["s"]).collect()) == [(1, 0), (3, 10)]
    assert [(r.episode, r.parts) for r in L.episodes(df, ["s"], 5).orderBy("episode").collect()] == [(1, 3), (2, 1)]
    days = L.by_study_day(spark.createDataFrame([(1, 86_390, 86_410)], "id int, start int, end int")).orderBy("day").collect()
    assert [(r.day, r["from"], r.to) for r in days] == [(0, 86_390, 86_400), (1, 86_400, 86_410)]


def test_fusion_ties_keep_the_first_ranking(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(3, 1), (2, 2)], "id int, rank int")
    got = Q.fused({"lexical": a, "semantic": b}).orderBy(F.desc("score"), "first").collect()
    assert [r.id for r in got] == [2, 1, 3] and got[0].signals == ["lexical", "semantic"]


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate([200, 10, 95, 5])], "k string, o int, n int")
    assert [r.o for r in Q.within_budget(df, "k", "o", "n", 100).collect()] == [0]
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate([50, 70, 30, 30, 20])], "k string, o int, n int")
    assert [r.o for r in Q.within_budget(df, "k", "o", "n", 100).orderBy("o").collect()] == [0, 2, 4]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", 7, 1), ("q", 8, 2), ("q", 9, 3)], "query string, id int, rank int")
    relevant = spark.createDataFrame([("q", 8), ("q", 8), ("q", 5)], "query string, id int")
    r = Q.metrics(ranked, relevant).head()
    assert (r.targets, r.recall, r.mrr) == (2, 0.5, 0.5)
    assert r.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_graders(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert values(spark, G.multiple(arr("a", "b"), arr("a", "b", "c")), G.multiple(arr("a", "x", "y"), arr("a", "b"))) == (pytest.approx(2 / 3), 0.0)
    assert values(spark, G.ordering(arr(1, 3, 2), arr(1, 2, 3)))[0] == pytest.approx(1 / 3)
    assert values(spark, G.numeric(F.lit("3,14 m"), F.lit(3.14), 0.0, 0.01), G.numeric(F.lit("x"), F.lit(1.0), 1.0, 1.0)) == (1.0, 0.0)
    assert values(spark, G.cited(F.lit("a [S2, S1] b [S2] [X1]")))[0] == [2, 1]
    spans = spark.createDataFrame([("a", 0, 3, 5), ("a", 3, 5, 5), ("b", 0, 2, 5), ("b", 3, 5, 5)], "k string, start int, end int, n int")
    assert {r.k: r.tiled for r in G.tiled(spans, "k", "n").collect()} == {"a": True, "b": False}


def test_text(spark):
    assert values(spark, X.roman(F.lit("MCMXCIV")), X.roman(F.lit("abc"))) == (1994, None)
    assert values(spark, X.number(F.lit("−1 204,5 kg")), X.number(F.lit("12 apples and 3"))) == (-1204.5, None)
    assert values(spark, X.duration(F.lit(3725)), X.duration(F.lit(65))) == ("1:02:05", "1:05")
    assert values(spark, X.reading_minutes(F.lit(15_000)), X.reading_minutes(F.lit(10))) == (10, 5)
    assert values(spark, X.normalized_url(F.lit("https://WWW.Example.com/a/#x")))[0] == "example.com/a"
    assert values(spark, X.public_url(F.lit("http://192.168.1.1/a")), X.public_url(F.lit("http://example.com:80/a")), X.public_url(F.lit("ftp://example.com")), X.public_url(F.lit("http://u@example.com"))) == (False, True, False, False)
    assert values(spark, X.sentences(F.lit("One. Two!\n\nThree")))[0] == ["One.", "Two!", "Three"]
    assert values(spark, X.excerpt(F.lit("a  b  c d"), 5), X.model_tokens(F.lit(0)), X.token_count(F.lit("Straße, 12!"))) == ("a b…", 1, 4)


def test_arrays(spark):
    assert values(spark, A.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))), A.hamming(F.lit(5), F.lit(1))) == (1.0, 1)
    assert values(spark, A.valid_vector(F.array(F.lit(1.0), F.lit(float("nan"))), 2), A.multiset_overlap(F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "abb")))) == (False, 2)


def test_tree_problems(spark):
    nodes = spark.createDataFrame([("a", None, 1, "A"), ("b", "a", 1, "B"), ("c", "zz", 1, "C"), ("d", "e", 1, "D"), ("e", "d", 1, "E")], "id string, parent_id string, ord long, title string")
    assert {r.id: r.problem for r in trees.problems(nodes).collect()} == {"c": "missing_parent", "d": "unreachable", "e": "unreachable"}
    assert {r.id: r.path for r in trees.walk(nodes).collect()} == {"a": "A", "b": "A / B"}


def test_plan(spark):
    items = spark.createDataFrame([("p", i, i, n) for i, n in enumerate([40, 40, 40, 500, 10])], "project string, id int, ord int, need bigint")
    days = spark.createDataFrame([("p", d, m) for d, m in enumerate([90, 0, 60, 60])], "project string, on_day int, minutes int")
    assert [r.on_day for r in P.distributed(items, days, "project").orderBy("id").collect()] == [0, 0, 2, 3, None]
    b = P.batches(items, "project", "id", "need", 100).orderBy("id").collect()
    assert [r.batch for r in b] == [0, 0, 1, 2, 3]


def _chunks_hold(chunks, expected, bounds):
    """No chunk is over the bound, nothing is lost, repeated pieces fit the overlap and are the last ones of the chunk before."""
    fresh = []
    for before, chunk in zip([[], *chunks], chunks):
        assert C.size(chunk) <= bounds.most
        n = next((k for k in range(min(len(before), len(chunk)), 0, -1) if before[-k:] == chunk[:k]), 0)
        assert C.size(chunk[:n]) <= bounds.overlap
        fresh += chunk[n:]
    assert " ".join(p.text for p in fresh).split() == expected.split()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 45), min_size=1, max_size=14), min_size=1, max_size=9), st.integers(0, 30))
def test_chunks_keep_all_within_bounds(paragraphs, overlap):
    bounds, n = C.Bounds(40, 60, overlap), iter(range(10_000))
    texts = [" ".join(" ".join(f"w{next(n)}" for _ in range(k)) + "." for k in p) for p in paragraphs]
    pieces = [C.Piece(t, C.count(t), i, i, False) for i, t in enumerate(texts)]
    _chunks_hold(bounds.dealt(pieces), " ".join(texts), bounds)
    sections = [C.Section(None, [C.Piece(f"H{i}", 1, 2 * i, i, True), p._replace(pos=2 * i + 1)], False) for i, p in enumerate(pieces)]
    _chunks_hold(bounds.packed(sections), " ".join(f"H{i} {t}" for i, t in enumerate(texts)), bounds)


def test_sections_are_packed():
    b = C.Bounds(20, 30, 5)
    piece = lambda n, s, h=False: C.Piece(" ".join([f"s{s}"] * n), n, s, s, h)
    one = lambda n, s, group=None, h=False: C.Section(group, [piece(n, s, h)], h)
    placed = lambda *x: [[p.section for p in c] for c in b.packed([*x])]
    assert placed(one(4, 0), one(5, 1), one(6, 2)) == [[0, 1, 2]]  # short sections go together
    assert placed(one(12, 0), one(12, 1)) == [[0], [1]]  # two that are long enough don't
    assert placed(one(8, 0), one(1, 1, h=True), one(12, 2)) == [[0], [1, 2]]  # a heading begins its own text's chunk
    assert placed(one(8, 0, "a"), one(8, 1, "b")) == [[0], [1]]  # a group ends
    assert placed(one(18, 0), one(12, 1), one(4, 2)) == [[0], [1, 2]]
    assert placed(one(18, 0), one(4, 1)) == [[0, 1]]  # a short tail joins
    assert len(b.packed([one(90, 0)])) == 6  # six pieces of half the bound; two would be further from the goal than one


def test_chunks_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts, by = dict(docs.collect()), {}
    for r in C.chunked(docs, "doc_id", "text", C.Bounds(100, 150, 20)).collect():
        by.setdefault(r.id, []).append(r)
    for i, chunks in by.items():
        chunks.sort(key=lambda r: r.chunk)
        assert chunks[0].first_piece == 0 and all(r.tokens <= 150 or r.first_piece == r.last_piece for r in chunks)
        assert all(a.last_piece + 1 >= b.first_piece >= a.first_piece and b.last_piece > a.last_piece for a, b in zip(chunks, chunks[1:]))  # a short chunk may be repeated whole
        assert set(texts[i].split()) == {w for r in chunks for w in r.text.split()}
    assert set(by) == {i for i, t in texts.items() if (t or "").strip()}


def test_drafts(spark):
    lines = [(1, 0, "Chapter 1 Sets", 1, True, 0, 0), (1, 1, "one two three four five six", 1, False, 0, 1), (1, 2, "1.1 Unions", 2, True, 1, 0), (1, 3, "seven eight nine ten eleven twelve more", 2, False, 1, 2)]
    df = spark.createDataFrame(lines, "k int, pos int, line string, section int, heading boolean, page int, quality int").withColumn("group", F.lit(None).cast("string"))
    pieces = C.packed_sections(df, "k", C.Bounds(40, 60, 5)).join(df.select("k", "pos", "page", "quality"), ["k", "pos"])
    titles = df.where("heading").select("k", "section", F.col("line").alias("title"), F.lit(False).alias("heading_only"))
    (d,) = C.drafts(pieces, C.parents(titles, "k", "section"), "k", F.lit("book")).collect()
    assert (d.title, d.page_from, d.page_to, d.quality, d.line_from, d.line_to, d.blocks) == ("Chapter 1 Sets › 1.1 Unions", 0, 1, 2, 0, 3, [1, 2])
    assert d.text.split("\n\n") == [x[2] for x in lines] and d.embedding_text == f"book — {d.title}\n\n{d.text}" and d.tokens == C.count(d.text)


def test_heading_matches_are_those_of_all_pairs(spark, sf_dir):
    """The blocking loses nothing: every pair that shares a word, scored in plain Python."""
    titles = {r.item_id: r.text.split(".")[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(25).collect()} | {900: "Transactions", 901: "2. Sets, and maps", 902: "Sets & maps of the first sort", 903: "..."}
    heads = {r.doc_id: (r.text or "").split("\n")[0].split(".")[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()} | {9000: "3) TRANSACTIONS", 9001: "sets and maps", 9002: "Set and map of the first sort", 9003: "Poetry"}
    words = lambda s: sorted(set(re.findall(X.TOKEN, s)))
    want = set()
    for i, title in titles.items():
        form = V._heading(title)
        same = sorted(h for h, t in heads.items() if form and V._heading(t) == form)
        if same:
            want |= {(i, h, 1.0, n, True) for n, h in enumerate(same, 1)}
            continue
        scored = sorted((-s, t, h) for h, t in heads.items() if form and set(words(form)) & set(words(V._heading(t))) and (s := V.score_headings(form, words(form), V._heading(t), words(V._heading(t)))) >= 0.45)
        auto = scored and -scored[0][0] >= 0.86 and -scored[0][0] - (-scored[1][0] if len(scored) > 1 else 0) >= 0.04
        want |= {(i, h, round(-s, 6), n, bool(auto)) for n, (s, _, h) in enumerate(scored[: 1 if auto else 5], 1)}
    got = S.heading_matches(spark.createDataFrame([*titles.items()], "title_id long, title string"), spark.createDataFrame([*heads.items()], "heading_id long, heading string"))
    assert {tuple(r) for r in got.collect()} == want and {(900, 9000), (901, 9001)} <= {(x[0], x[1]) for x in want if x[4]}


def test_headings(spark):
    titles = spark.createDataFrame([(1, "Linear algebra: matrices and vectors")], "title_id int, title string")
    heads = spark.createDataFrame([(10, "Linear algebra: matrices & vectors"), (11, "Matrices in linear systems"), (12, "Poetry")], "heading_id int, heading string")
    got = S.heading_matches(titles, heads).orderBy("place").collect()
    assert got[0].heading_id == 10 and got[0].auto and all(r.heading_id != 12 for r in got)


def test_identifiers_are_the_standards(spark):
    names = ["", "a", "événement:7", "x" * 300]
    got = [r.k for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", X.uuid5(F.col("n")).alias("k")).sort("i").collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names] and values(spark, X.uuid5(F.lit(None).cast("string"))) == (None,)


def test_recovery_of_plans(spark):
    items = spark.createDataFrame([("k", 1, 1, 2, 20, False, False), ("k", 2, 2, 3, 50, False, False), ("k", 3, 3, 1, 10, True, False), ("k", 4, 4, 4, 10, False, True), ("k", 5, 5, 11, 10, False, False), ("k", 6, 6, 4, 500, False, False)],
                                  "k string, id int, ord int, on_day bigint, need bigint, done boolean, pinned boolean")
    days = spark.createDataFrame([("k", d, m) for d, m in ((9, 90), (10, 60), (11, 90), (12, 30), (13, 100))], "k string, on_day bigint, minutes bigint")
    got = {m: {r.id: r.on_day for r in P.recovered(items, days, "k", 10, m).collect()} for m in ("dismiss", "catch_up", "spread")}
    kept = {3: 1, 4: 4, 5: 11}
    assert got["dismiss"] == kept
    assert got["catch_up"] == kept | {1: 10, 2: 13, 6: 4}  # day 11 had something on it, day 10 has 40 minutes left, nothing takes 500
    assert got["spread"] == kept | {1: 13, 2: 13, 6: 4}


def test_specific_terms(spark):
    assert values(spark, X.specific_terms(F.lit("What is io_uring, IS-LM or B-tree in v2 of ZFC and zfc? x 12 A-B")))[0] == ["What", "io_uring", "IS-LM", "v2", "ZFC"]


def test_same_questions(spark):
    rows = [("k", 1, "What is a group?"), ("k", 2, "what is a GROUP"), ("k", 3, "What is a groups?"), ("k", 4, "Why?"), ("j", 1, "What is a group?"), ("k", 5, "")]
    got = {(r.k, r.o): (r.of, r.how) for r in S.same_questions(spark.createDataFrame(rows, "k string, o int, t string"), "k", "o", "t").collect()}
    assert got == {("k", 2): (1, "equal"), ("k", 3): (1, "alike")}


def test_quotations_that_differ_late_are_told_apart(spark):
    start = "the same forty characters and more of a quotation that goes on "
    docs = spark.createDataFrame([(1, f"x {start}to one end here. y"), (2, f"x {start}to another end. y"), (3, "thee cat sat"), (4, "The -- CAT, sat")], "d long, t string")
    quotes = spark.createDataFrame([(1, start + "to one end here."), (2, (start + "to another end").upper()), (3, "the cat sat"), (4, "absent words of no document at all")], "quote_id long, quote string")
    got = {(r.quote_id, r.d): (r.how, r.start, r.end) for r in A2.located(A2.quoted(docs, quotes, "d", "t"), "t").collect()}
    assert got == {(1, 1): ("exact", 2, 2 + len(start) + 16), (2, 2): ("tokens", 2, 2 + len(start) + 14), (3, 4): ("tokens", 0, 15)}


def test_trees_of_any_depth(spark):
    rows = [("n0", None, 0, "t0")] + [(f"n{i}", f"n{i - 1}", i, f"t{i}") for i in range(1, 21)]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, ord int, title string")
    got = {r.id: r for r in trees.walk(nodes).collect()}
    assert len(got) == 21 and got["n20"].depth == 20 and got["n20"].path == " / ".join(f"t{i}" for i in range(21))
    assert trees.problems(nodes).collect() == []
    twice = nodes.union(spark.createDataFrame([("n0", "n2", 0, "again")], nodes.schema))
    assert max(r.depth for r in trees.walk(twice).collect()) == 20  # a row that would be its own ancestor


def test_html():
    title, text = html.readable('<html><title>A &amp; B</title><script>var t="</p>";</script><body><p>One<b>two</b><br>three</p><style>p{}</style><ul><li> x  y </li></ul>')
    assert title == "A & B" and text == "One two\nthree\n\nx y"  # stretches stand apart; an end and a beginning leave an empty line
    assert html.readable(None) == ("", "")
    assert html.readable("<title>Page</title><svg><title>Icon</title><path/></svg><p>a<p>b") == ("Page", "a\nb")
    assert html.readable("<div>one</div>\n\n<div></div><div></div>two <i>three</i>") == ("", "one\n\ntwo three")
    assert html.readable("a<br>b</br>c<br/>d</svg>e") == ("", "a\nb c\nde".replace("de", "d e"))
    assert html.readable("<svg><svg>x</svg>y</svg>z<svg><p>never ends<div>") == ("", "z")
    begun = time.time()
    assert len(html.readable("<p>x<li>" * 50_000)[1]) > 100_000 and time.time() - begun < 10


def test_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"\x00\xff"), "x"), (2, None, None)], "id int, b binary, s string")
    sinks.export_lines(df, str(tmp_path / "x"))
    got = sinks.import_lines(spark, str(tmp_path / "x"), df.schema).orderBy("id").collect()
    assert [(r.id, r.b and bytes(r.b), r.s) for r in got] == [(1, b"\x00\xff", "x"), (2, None, None)]


def test_files_once_by_content(spark, tmp_path):
    for name, body in (("a.txt", "same"), ("b.txt", "same"), ("c.md", "other"), ("d.txt", "new")):
        (tmp_path / name).write_text(body)
    found = files.files(spark, str(tmp_path), "*.txt")
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.txt", "d.txt"]
    assert [r.path.rsplit("/", 1)[1] for r in files.unknown(found, found.where(F.col("path").endswith("a.txt"))).collect()] == ["d.txt"]
    assert sorted(r.text for r in files.texts(spark, str(tmp_path)).collect()) == ["new", "other", "same", "same"]


def test_video_ids(spark):
    got = values(spark, *(X.video_id(F.lit(u)) for u in ("https://www.youtube.com/watch?a=1&v=abcdefghijk", "https://youtu.be/ABCDEFGHIJ_?t=3", "https://example.com/watch?v=short")))
    assert got == ("abcdefghijk", "ABCDEFGHIJ_", None)


def test_vectorised_text(spark):
    df = spark.createDataFrame([("ＡＢＣ — Straße", "Ёлка, 12", ["matrix", "vektor", "zz"], ["matrices", "vector", "matrix"]), (None, None, None, None)], "a string, b string, c array<string>, d array<string>")
    rows = df.select(V.normalized(F.col("a")).alias("n"), V.token_positions(F.col("b")).alias("t"), V.soft_overlap(F.col("c"), F.col("d")).alias("o")).collect()
    assert rows[0].n == "abc strasse" and rows[1].n is None
    assert [(x.token, x.start, x.end) for x in rows[0].t] == [("елка", 0, 4), ("12", 6, 8)] and rows[1].t == []
    assert (rows[0].o, rows[1].o) == (2, 0)
    assert values(spark, V.with_synonyms(F.lit("A car, CAR and cars $"), {"car": "auto$"}))[0] == "A auto$, auto$ and cars $"
