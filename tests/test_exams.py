"""Exam lists against a reader that goes line by line."""

import random
import re

from quillwork.operators import exams as Q
from quillwork.plans import materials

ITEM = re.compile(r"^\s*(?:(\d{1,4})[.)](?!\d)\s*|(\d{1,4})\s+)(\S.*?)\s*$")
PART, MARK, TASK = re.compile(Q.PART), re.compile(Q.MARK), re.compile(r"^\s*(?:Задача|Задание)\s*:\s*(.+)$", re.I)


def named(text):
    m = TASK.match(text)
    return (m[1].strip(), "task") if m else (text.strip(), "question")


def item(line):
    m = ITEM.match(line)
    return m and (int(m[1] or m[2]), m[3].strip())


def read_list(text):
    rows = [x.strip() for x in re.split(r"\r\n|\r|\n", text or "") if x.strip()]
    rows = [x for r in rows for x in re.split(Q.INLINE, r) if x]
    series = []
    for at, line in enumerate(rows):
        if not PART.match(line) and item(line):
            if not series or item(line)[0] != series[-1][-1][1] + 1:
                series.append([])
            series[-1].append((at, item(line)[0]))
    if not series:
        return read_marks(rows), 0, None
    longest = [s for s in series if len(s) == max(map(len, series))]
    if len(longest) > 1:
        return [], 0, "ambiguous"
    starts, nodes, warnings = dict(longest[0]), [], 0
    top, number, child = None, None, 0
    for at, line in enumerate(rows):
        part = PART.match(line)
        if at in starts:
            title, kind = named(item(line)[1])
            top, number, child = len(nodes), starts[at], 0
            nodes.append([None, "topic", kind, title, len([n for n in nodes if n[0] is None])])
        elif top is None or (not part and (item(line) or re.fullmatch(r"\d{1,4}", line))):
            continue
        elif part and int(part[1]) == number and int(part[2]) > child:
            child = int(part[2])
            nodes.append([top, "part", nodes[top][2], part[3].strip(), child - 1])
        else:
            warnings += bool(part)
            nodes[-1][3] = f"{nodes[-1][3]} {part[3].strip() if part else line}".strip()
    return nodes, warnings, None


def read_marks(rows):
    marks, nodes, kind = any(MARK.match(x) for x in rows), [], "question"
    for line in rows:
        if re.match(r"^\s*Вопросы\s*:??\s*$", line, re.I):
            kind = "question"
            continue
        m = MARK.match(line)
        if not m and marks and nodes:
            nodes[-1][3] += f" {line}"
            continue
        title, k = named(m[1] if m else line)
        nodes.append([None, "topic", k if k == "task" else kind, title, len(nodes)])
    return nodes


def read_tickets(text):
    nodes, ticket, inside, error, tickets = [], None, 0, None, 0
    for line in (x.strip() for x in re.split(r"\r\n|\r|\n", text or "") if x.strip()):
        m = re.match(r"^\s*Билет\s*(?:№|#)?\s*(\d+)\s*(?:[.:—-]\s*)?(.*?)\s*$", line, re.I)
        if m:
            error = error or ("empty_ticket" if ticket is not None and not inside else None)
            ticket, inside = len(nodes), 0
            nodes.append([None, "section", "ticket", f"Билет {m[1]}" + (f": {m[2]}" if m[2] else ""), tickets])
            tickets += 1
        elif ticket is None or re.fullmatch(r"\d{1,4}", line):
            continue
        elif MARK.match(line):
            title, kind = named(MARK.match(line)[1])
            nodes.append([ticket, "topic", kind, title, inside])
            inside += 1
        elif inside:
            nodes[-1][3] += f" {line}"
        else:
            error = "unmarked"
    error = "no_ticket" if ticket is None else error or (None if inside else "empty_ticket")
    return [] if error else nodes, 0, error


def compare(spark, texts, found, reader):
    nodes, reports = found
    got, told = {}, {r.key: r for r in reports.collect()}
    for r in nodes.collect():
        got.setdefault(r.key, []).append((r.node, [r.parent, r.type, r.kind, r.title, r.position]))
    for key, text in texts.items():
        want, warnings, error = reader(text)
        mine = sorted(got.get(key, []), key=lambda x: x[0])
        assert [n for n, _ in mine] == list(range(len(want))) and [x for _, x in mine] == want, text
        titles = [n[3].lower() for n in want if n[1] != "section"]
        r = told[key]
        assert (r.error, r.duplicates, r.parts) == (error or (None if want else "empty"), len({t for t in titles if titles.count(t) > 1}), sum(n[1] == "part" for n in want)), text
        assert (r.tickets, r.questions, r.tasks) == (sum(n[1] == "section" for n in want), *(sum(n[1] == "topic" and n[2] == k for n in want) for k in ("question", "task")))
        assert error or r.warnings == warnings, text
    assert set(told) == set(texts)


LINES = ["1. One", "2. Two", "3) Three", "4 Four", "2.1 first", "2.2. second", "2.1 again", "9.9 stray", "goes on", "17", "Задача: a task", "2. Задание: do it. 3. And more", "— dash", "• dot", "Вопросы:", "1. One"]
TICKETS = ["Билет 1", "билет № 2. Theme", "Билет", "1. a", "2) Задача: b", "— c", "text", "12", "title page"]


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "key int, text string")


def test_lists(spark):
    rng = random.Random(3)
    texts = {i: "\n".join(rng.choice(LINES) for _ in range(rng.randrange(14))) for i in range(150)}
    texts |= {200: None, 201: "", 202: "1. A\r\n1.1 x\r1.2 y\n\n 2. B ", 203: "just\nlines", 204: "1. A\n2. B\n1. A\n2. B"}
    compare(spark, texts, Q.exam_list(frame(spark, texts), spark.createDataFrame([], "key int, expected int")), read_list)


def test_tickets(spark):
    rng = random.Random(4)
    texts = {i: "\n".join(["Билет 7", "1. q"] * (i % 2) + [rng.choice(TICKETS) for _ in range(rng.randrange(9))]) for i in range(150)} | {200: None, 201: ""}
    compare(spark, texts, Q.tickets(frame(spark, texts)), read_tickets)


def test_query_texts(spark, sf_dir):
    rows = materials._exam_texts(spark, sf_dir).collect()
    lists, programs = ({r.key: r.text for r in rows if (r.kind == 2) == is_} for is_ in (False, True))
    assert lists and programs
    compare(spark, lists, Q.exam_list(frame(spark, lists), spark.createDataFrame([], "key int, expected int")), read_list)
    compare(spark, programs, Q.tickets(frame(spark, programs)), read_tickets)
