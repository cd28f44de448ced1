"""Linking of answer files against plain Python over each file."""

import random
import re
from collections import defaultdict, namedtuple

import pytest

from quillwork.functions import text as X
from quillwork.functions import vectorised as V
from quillwork.operators import answers as W
from quillwork.sources import tables as T

NUMBER = re.compile(W.NUMBER, re.IGNORECASE)


def number(text):
    m = NUMBER.match(text)
    return m and (int(m[1]), int(m[2]) if m[2] else None)


def plain(fragments, questions, resolved, manual, edited):
    """One file. fragments: (pos, text, kind) in order; questions: (ord, title, root, child)."""
    words = lambda s: list(dict.fromkeys(re.findall(X.TOKEN, s)))
    stem = lambda s: {w[:6] for w in re.findall("[a-zа-я0-9]{4,}", s)}
    form = {o: V._heading(t) for o, t, *_ in questions}
    title = {o: t for o, t, *_ in questions}
    score = lambda f, o: V.score_headings(f, words(f), form[o], words(form[o]))
    target = {}
    for o, _, root, child in sorted(questions, reverse=True):
        if root is not None:
            target[root, child] = o
    numbers = [number(t) for _, t, k in fragments if k == "heading" and number(t)]
    follows = all(b == (a[0] + 1, None) or (b[0] == a[0] and b[1] == (a[1] or 0) + 1) for a, b in zip(numbers, numbers[1:], strict=False))
    trust = len(numbers) > 1 and all(n in target for n in numbers) and follows
    found = {}
    for i, (_, text, kind) in enumerate(fragments):
        if kind not in W.KINDS or not text.strip():
            continue
        n, choices = number(text), []
        for end in range(i + 1, min(len(fragments), i + 4) + 1):
            if end > i + 1 and (kind == "heading" or number(fragments[end - 1][1])):
                break
            head = " ".join(" ".join(t.split()) for _, t, _ in fragments[i:end])[:500].strip()
            f = V._heading(head)
            if f in resolved:
                choices.append((True, 1.0, -end, 0, -resolved[f], "resolved", head, bool(n)))
                continue
            goal = target.get(n) if n else None
            near = []
            for o in form:
                both, m = len(stem(f) & stem(form[o])), len(stem(form[o]))
                gate = both and both >= min(2, m) and both >= 0.45 * m and both >= 0.25 * len(stem(f) | stem(form[o]))
                if (both if goal else gate) or o == goal:
                    near.append((score(f, o), o))
            sure = 0.0
            if goal:
                sure = score(f, goal)
                choices.append((sure >= 0.45 or (kind == "heading" and trust), sure, -end, 1, -goal, "exact" if sure >= 0.999 else "number", head, True))
            if sure < 0.45:
                once = {}
                for s, o in near:
                    if s >= 0.45:
                        key = title[o].lower()
                        once[key] = min(once.get(key, (o, s)), (o, s))
                ranked = sorted(((s, -o) for o, s in once.values()), reverse=True)
                if ranked:
                    s, o = ranked[0]
                    choices.append((s >= 0.86 and s - (ranked[1][0] if len(ranked) > 1 else 0) >= 0.04, s, -end, 0, o, "exact" if s >= 0.999 else "fuzzy", head, bool(goal)))
        if choices:
            found[i] = max(choices)
    certain = [(i, -c[2], -c[4], c[1]) for i, c in sorted(found.items()) if c[0]]
    best = []  # (sum, path)
    for i, c in enumerate(certain):
        before = max((b for b, d in zip(best, certain[:i], strict=True) if d[1] <= c[0] and d[2] < c[2]), key=lambda b: b[0], default=(0.0, []))
        best.append((before[0] + 10 + c[3], [*before[1], i]))
    chain = max(best, key=lambda b: b[0])[1] if best else []
    stops = [i for i, c in sorted(found.items()) if c[1] >= 0.86 or (fragments[i][2] == "heading" and c[1] >= 0.45)]
    sections, links, answers = [], set(manual), {}
    for n, i in enumerate(chain):
        anchor, until, o, _ = certain[i]
        after = certain[chain[n + 1]][0] if n + 1 < len(chain) else len(fragments)
        end = min(after, max(next((s for s in stops if s > anchor), len(fragments)), until))
        sections.append((anchor, until, end, o, found[anchor][5]))
        for twin in (x for x in title if title[x].lower() == title[o].lower()):
            links |= {(fragments[j][0], twin) for j in range(until, end)}
            if until < end:
                answers.setdefault(twin, set()).update(range(until, end))
    told = {o: ("preserve" if o in edited else "create", "\n".join(fragments[j][1].strip() for j in sorted(js))) for o, js in answers.items()}
    linked = {x for *_, o, _ in sections for x in title if title[x].lower() == title[o].lower()}
    hints = {}
    for i, c in sorted(found.items()):
        o = -c[4]
        if not c[0] and o not in linked and c[1] >= 0.45 and (c[7] or fragments[i][2] == "heading" or c[1] >= 0.7) and (o not in hints or c[1] > hints[o][1]):
            hints[o] = (i, c[1])
    return sorted(sections), sorted(links), told, {o: (i, round(s, 9)) for o, (i, s) in hints.items()}, sorted(set(title) - linked)


def compare(spark, t):
    got = W.linked(*(t[k] for k in ("fragments", "questions", "resolved", "manual", "edited")))
    def grouped(df, f):
        out = defaultdict(list)
        for r in df.collect():
            out[r.key].append(f(r))
        return out

    frag = grouped(t["fragments"].sort("key", "pos"), lambda r: (r.pos, r.text or "", r.kind))
    ask = grouped(t["questions"], lambda r: (r.ord, r.title, r.root, r.child))
    res, man, ed = grouped(t["resolved"], lambda r: (r.form, r.ord)), grouped(t["manual"], lambda r: (r.pos, r.ord)), grouped(t["edited"], lambda r: r.ord)
    sections, links, answers = grouped(got.sections, lambda r: (r.anchor, r.until, r.end, r.ord, r.method)), grouped(got.bindings, lambda r: (r.pos, r.ord)), grouped(got.answers, lambda r: (r.ord, (r.action, r.text)))
    hints, missing = grouped(got.suggestions, lambda r: (r.ord, (r.anchor, round(r.score, 9)))), grouped(got.missing, lambda r: r.ord)
    for key in ask:
        want = plain(frag[key], ask[key], dict(res[key]), man[key], set(ed[key]))
        assert (sorted(sections[key]), sorted(links[key]), dict(answers[key]), dict(hints[key]), sorted(missing[key])) == want, key
    return got


def test_linking_of_whole_files(spark, sf_dir):
    t = {k: df.where("key < 25") for k, df in T.answer_files(spark, sf_dir).items()}  # plain Python takes its time
    got = compare(spark, t)
    assert {r.method for r in got.sections.collect()} >= {"exact", "fuzzy", "resolved"}
    assert {r.origin for r in got.bindings.collect()} == {"auto", "manual"} and {r.action for r in got.answers.collect()} == {"create", "preserve"}


def test_numbers_are_trusted_as_a_series_only(spark):
    q = [("a", 1, "Sets and their unions", 1, None), ("a", 2, "Unions of families", 1, 1), ("a", 3, "Ordered pairs", 2, None), ("a", 4, "sets and their UNIONS", 3, None)]
    f = [("a", 1, "1. Something quite different", "heading"), ("a", 2, "Text of it.", "paragraph"), ("a", 3, "1.1 Else", "heading"), ("a", 4, "2) More\x0bwords", "heading"), ("a", 5, "1. not this", "paragraph"), ("a", 6, None, "paragraph"), ("a", 7, "last", "table")]
    schema = {"fragments": "key string, pos int, text string, kind string", "questions": "key string, ord int, title string, root int, child int", "resolved": "key string, form string, ord int", "manual": "key string, pos int, ord int", "edited": "key string, ord int"}
    for keys in ((0, 1, 2, 3, 4, 5, 6), (0, 1, 3, 4)):
        t = {"fragments": [f[i] for i in keys], "questions": q, "resolved": [], "manual": [("a", 5, 3)], "edited": [("a", 3)]}
        got = compare(spark, {k: spark.createDataFrame(v, schema[k]) for k, v in t.items()})
        trusted = [r.key for r in W.trusted(spark.createDataFrame(t["fragments"], schema["fragments"]), spark.createDataFrame(q, schema["questions"])).collect()]
        assert trusted == ["a"] and {r.method for r in got.sections.collect()} == {"number"}
    empty = {k: spark.createDataFrame([], s) for k, s in schema.items()}
    got = W.linked(*(empty[k] for k in schema))
    assert [x.count() for x in (got.sections, got.bindings, got.answers, got.suggestions, got.missing)] == [0] * 5


@pytest.mark.parametrize("seed", range(6))
def test_best_path_is_the_best_of_all(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n = rng.randrange(9)
        anchor = sorted(rng.sample(range(20), n))
        until = [a + rng.randrange(1, 5) for a in anchor]
        node, score = [rng.randrange(6) for _ in range(n)], [rng.choice([0.5, 0.9, 1.0]) for _ in range(n)]
        sums = []
        for mask in range(1 << n):
            p = [i for i in range(n) if mask >> i & 1]
            if all(until[a] <= anchor[b] and node[a] < node[b] for a, b in zip(p, p[1:], strict=False)):
                sums.append(sum(10 + score[i] for i in p))
        p = W.best_path(anchor, until, node, score)
        assert all(until[a] <= anchor[b] and node[a] < node[b] for a, b in zip(p, p[1:], strict=False))
        assert abs(sum(10 + score[i] for i in p) - max(sums)) < 1e-9


def test_a_header_is_scored_only_with_what_may_be_its_best(monkeypatch):
    rng, scored = random.Random(3), []
    whole = V.score_headings
    monkeypatch.setattr(V, "score_headings", lambda *a: scored.append(a[2]) or whole(*a))
    some = ["amber", "copper", "violet", "silver", "maroon", "indigo", "crimson", "salmon"]
    titles = [f"{a} {b} plated tin of brand {rng.randrange(10, 60)}, supply and demand" for a in some for b in some if a < b]
    row = namedtuple("row", "key part pos ord text lower kind root child")
    rows = [row(1, W.QUESTION, None, i, t, t, None, i, None) for i, t in enumerate(titles)]
    for i, t in enumerate(titles):
        texts = [("paragraph", t.replace("o", "0")), ("paragraph", "The answer says this and goes on."), ("list", "and on")]
        rows += [row(1, W.FRAGMENT, 10 * i + j, None, text, None, kind, None, None) for j, (kind, text) in enumerate(texts)]
    got = list(W.of_file(rows))
    sections = [(r[2], r[5], r[7]) for r in got if r[1] == "section"]
    assert len(sections) >= 10 and all(x == (3 * x[1], x[1], "fuzzy") for x in sections)
    # Each of 28 headers of up to four fragments shares enough stems with all 28 questions.
    assert len(scored) < 4 * len(titles), len(scored)


def test_linking_of_odd_files(spark):
    rng = random.Random(11)
    vocabulary = ["Sets", "unions", "families", "ordered", "pairs", "Ёлки", "straße", "limits", "ﬁnite", "of", "the", "sequences", "sequence's", "№", "∑", "functions", "12", "Σύνολα"]

    def said(n):
        t = " ".join(rng.choice(vocabulary) for _ in range(n))
        t = t.replace(rng.choice("eosi"), rng.choice("eo0s")) if rng.random() < 0.4 else t
        return rng.choice([t, t.upper(), f"  {t} ", f"{rng.randrange(1, 7)}. {t}", f"{rng.randrange(1, 4)}.{rng.randrange(1, 3)} {t}", f"Задача № {rng.randrange(1, 7)}: {t}", t.replace(" ", "\x0b "), f"{t}, {t}"])

    t = {k: [] for k in ("fragments", "questions", "resolved", "manual", "edited")}
    for key in map(str, range(60)):
        titles = [said(rng.randrange(1, 7)) for _ in range(rng.randrange(1, 9))]
        titles += [x.lower() for x in titles[:2]] + [""]
        t["questions"] += [(key, i + 1, x, i + 1 if rng.random() < 0.7 else None, rng.choice([None, None, 1])) for i, x in enumerate(titles)]
        t["questions"] = [(k, o, x, r, c if r else None) for k, o, x, r, c in t["questions"]]
        texts = [rng.choice([rng.choice(titles), said(rng.randrange(1, 7)), said(2) * rng.choice([1, 60]), "", None, "..."]) for _ in range(rng.randrange(40))]
        t["fragments"] += [(key, i, x, rng.choice(["heading", "paragraph", "paragraph", "list", "table"])) for i, x in enumerate(texts)]
        t["resolved"] += [(key, V._heading(x or ""), rng.randrange(len(titles)) + 1) for x in {y: 0 for y in rng.sample(texts, min(len(texts), 1))}]
    t["manual"], t["edited"] = [("1", 2, 1), ("2", 5, 2)], [("1", 1), ("3", 2)]
    schema = {"fragments": "key string, pos int, text string, kind string", "questions": "key string, ord int, title string, root int, child int", "resolved": "key string, form string, ord int", "manual": "key string, pos int, ord int", "edited": "key string, ord int"}
    got = compare(spark, {k: spark.createDataFrame(v, schema[k]) for k, v in t.items()})
    assert {r.method for r in got.sections.collect()} >= {"exact", "fuzzy", "number", "resolved"}
