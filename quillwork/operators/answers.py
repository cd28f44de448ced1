"""Files of reference answers linked to an exam's questions: headers are found, matched, put in an order that agrees with the
exam's, and what stands between them is bound to the questions and becomes their answers.

What links a file is a program over its rows and its exam's questions, which are dealt out by file. Headers meet questions by
word stems, so no header is compared with all questions, and of those that it meets only what may be the best, or near enough to
the best to make it doubtful, is scored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import groups
from ..functions import text as X
from ..functions import vectorised as V
from ..sources import shared

# Fragments and characters of a header; scores at which a match is certain, worth a suggestion, and enough
# beside a number; how far the best must be ahead; what an unnumbered paragraph's suggestion needs; a question's worth in a path.
FRAGMENTS, CHARACTERS = 4, 500
SURE, LIKELY, NUMBERED, AHEAD, PLAIN, WORTH = 0.86, 0.45, 0.45, 0.04, 0.7, 10.0
# Kinds that may begin a header, and how a number is written.
KINDS = ("heading", "paragraph", "list")
NUMBER = r"^\s*(?:(?:вопрос|задача|задание)\s*(?:№|#)?\s*)?(\d{1,3})(?:\.(\d{1,3}))?(?:[.)]|\s)"
# The gate of a comparison: stems of six characters of words of four and more, at least two in common (or all),
# with a share of the question's and of both together.
STEM, STEMS, OF_QUESTION, OF_BOTH = 6, 2, 0.45, 0.25
# The score from which a match is called exact, and what sums of floats may be off by.
EXACT, SLACK = 0.999, 1e-9
# What a file's rows are, and what its program gives beside the key and what it is.
QUESTION, RESOLVED, FRAGMENT = range(3)
GIVEN = ("anchor", "until", "end", "ord", "title", "method", "score", "places", "text")
_STEM, _TOKEN = re.compile("[a-zа-я0-9]{4,}"), re.compile(X.TOKEN)
_BLANK = "[ \\t\\n\\x0b\\f\\r]"  # as Java's expressions have it; so are digits
_NUMBER, _BLANKS = re.compile(NUMBER.replace(r"\s", _BLANK).replace(r"\d", "[0-9]"), re.IGNORECASE), re.compile(f"{_BLANK}+")


class Found(NamedTuple):
    """An anchor's header with its question."""

    sure: bool
    score: float
    until: int
    ord: int
    method: str
    title: str
    numbered: bool

    def rank(self) -> tuple:
        return self.sure, self.score, -self.until, self.method == "number", -self.ord


def stems(form: str) -> set[str]:
    return {w[:STEM] for w in _STEM.findall(form)}


def words(form: str) -> list[str]:
    return list(dict.fromkeys(_TOKEN.findall(form)))


def numbered(text: str) -> tuple[int | None, int | None]:
    m = _NUMBER.match(text)
    return (int(m[1]), int(m[2]) if m[2] else None) if m else (None, None)


def in_series(numbers: list[tuple[int, int | None]], known: set[tuple[int, int]]) -> bool:
    """Whether numbers are one series of known ones: each is the next question or the next part of one."""
    before, part = None, 0
    for root, child in numbers:
        if before is None:
            follows = child is None or child == 1
        else:
            follows = root == before + 1 if child is None else root == before and child == part + 1
        if not follows or (root, child or 0) not in known:
            return False
        before, part = root, child or 0
    return len(numbers) > 1


def _trust(rows: list) -> bool:
    """Whether a file's numbered headings are one series of its exam's questions."""
    numbers = (numbered(r.text) for r in rows if r.part == FRAGMENT and r.kind == "heading")
    return in_series([n for n in numbers if n[0] is not None], {(r.root, r.child or 0) for r in rows if r.part == QUESTION and r.root is not None})


def trusted(fragments: DataFrame, questions: DataFrame) -> DataFrame:
    """key: files whose numbered headings are one series of questions."""
    rows = _dealt(fragments.where("kind = 'heading'"), questions)
    return groups.over(rows.where("key IS NOT NULL"), ["key"], ["part", "pos"], lambda x: [(x[0].key,)] if _trust(x) else [], f"key {dict(rows.dtypes)['key']}")


def _dealt(fragments: DataFrame, questions: DataFrame, *resolved: DataFrame) -> DataFrame:
    """The rows of files and their exams in one table."""
    parts = [
        questions.select("key", F.lit(QUESTION).alias("part"), "ord", F.col("title").alias("text"), F.lower("title").alias("lower"), "root", "child"),
        *(r.select("key", F.lit(RESOLVED).alias("part"), F.col("form").alias("text"), "ord") for r in resolved),
        fragments.select("key", F.lit(FRAGMENT).alias("part"), "pos", F.coalesce("text", F.lit("")).alias("text"), "kind"),
    ]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


class Exam:
    """One exam's questions (ord, title, its lower case, root, child), as headers meet them: equal forms are one, found by stems or
    by number. A question without ord meets nothing."""

    def __init__(self, questions: Iterable[tuple]):
        self.named: dict[str, list[tuple]] = {}  # form: (ord, lower case) of its questions
        self.target: dict[tuple, int] = {}  # number: ord
        self.forms: dict[int, list[str]] = {}  # ord: forms
        self.lower: dict[int, list[str]] = {}  # ord: lower cases
        self.twins: dict[str, list[int]] = {}  # lower case: ords
        self.by_stem: dict[str, list[str]] = {}  # stem: forms
        for ord_, title, lower, root, child in questions:
            if ord_ is None:
                continue
            form = V._heading(title or "")
            self.named.setdefault(form, []).append((ord_, lower))
            self.forms.setdefault(ord_, []).append(form)
            if root is not None:
                number = root, child or 0
                self.target[number] = min(ord_, self.target.get(number, ord_))
            if lower is not None:
                self.lower.setdefault(ord_, []).append(lower)
                self.twins.setdefault(lower, []).append(ord_)
        self.words, self.stems = {f: words(f) for f in self.named}, {f: len(stems(f)) for f in self.named}
        self.by_word: dict[str, list[str]] = {}  # word: forms
        for f in self.named:
            for stem in stems(f):
                self.by_stem.setdefault(stem, []).append(f)
            for word in self.words[f]:
                self.by_word.setdefault(word, []).append(f)
        self.fewest = min((max(min(STEMS, n), OF_QUESTION * n) for n in self.stems.values() if n), default=1)  # stems that any gate needs
        self.vocabulary = [(w, len(w), V._set(w)) for w in self.by_word]
        self._partners: dict[str, list[tuple[str, float]]] = {}

    def met(self, form: str, any_: bool) -> list[str]:
        """Forms that share enough stems with a header's, or (``any_``) stems at all."""
        own, both = stems(form), {}
        for stem in own:
            for f in self.by_stem.get(stem, ()):
                both[f] = both.get(f, 0) + 1
        return [f for f, n in both.items() if any_ or (n >= min(STEMS, self.stems[f]) and n >= OF_QUESTION * self.stems[f] and n >= OF_BOTH * (len(own) + self.stems[f] - n))]

    def partners(self, word: str) -> list[tuple[str, float]]:
        """Forms with a word that may be a word's partner, and how alike the most alike is."""
        if (found := self._partners.get(word)) is None:
            k, x, best = len(word), V._set(word), {}
            for w, m, y in self.vocabulary:
                both = 0.4 * (k + m) - SLACK
                if k >= both and m >= both and k - (x & ~y).bit_count() >= both and (r := V.partner(word, w)):
                    for f in self.by_word[w]:
                        best[f] = max(r, best.get(f, 0.0))
            found = self._partners[word] = list(best.items())
        return found

    def bounds(self, form: str, own: list[str], near: list[str], least: float) -> list[tuple[float, float, str]]:
        """What a header may score at most with forms, where that is ``least`` at least, largest first, and the share of words in it:
        no more words are in common than have partners, no more characters than the shorter has."""
        have = dict.fromkeys(near, 0.0)
        for word in own if near else ():
            for f, r in self.partners(word):
                if f in have:
                    have[f] += r
        out, m, n = [], len(form), len(own)
        for f, both in have.items():
            k, others = len(f), len(self.words[f])
            both = min(both, n, others)
            share = both / max(n + others - both, 1)
            if (top := (share + 2 * min(m, k) / max(m + k, 1)) / 2) >= least:
                out.append((top, share, f))
        return sorted(out, reverse=True)

    def score(self, form: str, own: list[str], f: str, share: float, least: float) -> float:
        """A header's score with a form, 0 if the characters in the same order keep it under ``least``."""
        if form == f and own:
            return 1.0
        return V.score_headings(form, own, f, self.words[f]) if (share + 2 * V._in_order(form, f) / max(len(form) + len(f), 1)) / 2 >= least else 0.0

    def by_number(self, form: str, target: int, heading: bool, trust: bool) -> list[float]:
        """Scores of a numbered header and its questions, without some that are under the bar; a trusted heading, whose number counts
        in any case, has all."""
        own = words(form)
        forms = [f for f in self.forms[target] if heading or most(form, own, f, self.words[f]) >= NUMBERED]
        if trust or not form:
            return [V.score_headings(form, own, f, self.words[f]) for f in forms]
        return [self.score(form, own, f, share, NUMBERED - SLACK) for _, share, f in self.bounds(form, own, forms, NUMBERED - SLACK)]

    def nearest(self, form: str, near: list[str], bar: float, ahead: float) -> tuple[float, int, float] | None:
        """The best score with its question (the first of equal ones), and the next best score of another title, 0 if it is too
        far behind to count; None without a score of ``bar``. Nothing that is AHEAD behind ``ahead`` or the best so far is scored:
        no characters in common could bring it there."""
        own, best, titles = words(form), 0.0, {}
        least = max(bar, max(ahead, float(form in near)) - AHEAD) - SLACK
        near = [f for f in near if most(form, own, f, self.words[f]) >= max(LIKELY, least)]
        for bound, share, f in self.bounds(form, own, near, least):
            least = max(bar, max(ahead, best) - AHEAD) - SLACK
            if bound < least:
                break
            score = self.score(form, own, f, share, least)
            if score >= LIKELY:
                best = max(best, score)
                for ord_, lower in self.named[f]:
                    o, x = titles.get(lower, (ord_, score))
                    titles[lower] = min(o, ord_), max(x, score)
        if best < bar:
            return None
        first, *rest = sorted((-x, o) for o, x in titles.values())
        return -first[0], first[1], -rest[0][0] if rest else 0.0


def most(form: str, own: list[str], other: str, others: list[str]) -> float:
    """The best score that the lengths of two forms and the numbers of their words allow."""
    a, b, m, n = len(own), len(others), len(form), len(other)
    return (min(a, b) / max(a, b, 1) + 2 * min(m, n) / max(m + n, 1)) / 2


def candidates(exam: Exam, fragments: list[tuple[str, str]], resolved: dict[str, int], trust: bool) -> Iterator[tuple[int, Found]]:
    """The places (from 0) of fragments (text, kind) that may be headers, each with its best header.

    A header begins at a fragment. A heading is one fragment; a paragraph may go on for FRAGMENTS of them, up to the next numbered
    one. A resolved heading (``form``: somebody chose) goes before all, then the question of its number, then the best of those
    that share stems. Of an anchor's choices the certain one counts, then the best, then the shortest header.

    Left out is what nothing comes of: an uncertain header that is no suggestion either, for which a paragraph without a
    question's number needs a score of PLAIN, every other header one of LIKELY.
    """
    numbers = [numbered(text) for text, _ in fragments]
    squeezed = [_BLANKS.sub(" ", text).strip(" ") for text, _ in fragments]
    own = [stems(V.folded(text)) for text in squeezed]
    known = [s & exam.by_stem.keys() for s in own]
    chosen = [stems(form) for form in resolved]
    for i, (text, kind) in enumerate(fragments):
        if kind not in KINDS or not text.strip(" "):
            continue
        root, child = numbers[i]
        heading, target = kind == "heading", None if root is None else exam.target.get((root, child or 0))
        bar, best = LIKELY if heading or target is not None else PLAIN, None
        for until in range(i + 1, min(len(fragments), i + (1 if heading else FRAGMENTS)) + 1):
            if until > i + 1 and numbers[until - 1][0] is not None:
                break
            joined = " ".join(squeezed[i:until])
            # A whole header's stems are among those of its fragments: without enough of them it needn't be made.
            if target is None and len(joined) <= CHARACTERS and len(set().union(*known[i:until])) < exam.fewest and not any(c <= set().union(*own[i:until]) for c in chosen):
                continue
            title = joined[:CHARACTERS].strip(" ")
            form = V._heading(title)
            if form in resolved:
                choices = [Found(True, 1.0, until, resolved[form], "resolved", title, root is not None)]
            else:
                scores = [] if target is None else exam.by_number(form, target, heading, heading and trust)
                named = lambda s, other: "exact" if s >= EXACT else other
                choices = [Found(True, s, until, target, named(s, "number"), title, True) for s in scores if s >= NUMBERED or (heading and trust)]
                if not any(s >= NUMBERED for s in scores) and (near := exam.met(form, target is not None)):
                    ahead = 0.0 if best is None else best.score if best.sure else min(best.score, SURE)
                    if found := exam.nearest(form, near, bar, ahead):
                        s, ord_, after = found
                        choices.append(Found(s >= SURE and s - after >= AHEAD, s, until, ord_, named(s, "fuzzy"), title, target is not None))
            best = max([*choices, *([best] if best else [])], key=Found.rank, default=None)
            if best and best.sure and best.score >= 1:
                break
        if best:
            yield i, best


def best_path(anchor: list[int], until: list[int], node: list[int], score: list[float]) -> list[int]:
    """Indices of the path of largest sum (score and WORTH each) in which headers don't overlap and questions come in order; rows
    are in the order of their anchors. The best sums of paths that end at or before a question are kept in a tree of maxima."""
    rank = {n: i + 1 for i, n in enumerate(sorted(set(node)))}
    tree: list[tuple[float, int]] = [(0.0, 1)] * (len(rank) + 1)  # (sum, -index); larger is better, so earlier wins ties
    best, back, waiting = [], [], []
    for i, a in enumerate(anchor):
        for j in [j for j in waiting if until[j] <= a]:
            waiting.remove(j)
            k = rank[node[j]]
            while k <= len(rank):
                tree[k] = max(tree[k], (best[j], -j))
                k += k & -k
        k, before = rank[node[i]] - 1, (0.0, 1)
        while k:
            before = max(before, tree[k])
            k -= k & -k
        best.append(before[0] + score[i] + WORTH)
        back.append(-before[1])
        waiting.append(i)  # at most FRAGMENTS headers are open at once
    at = max(range(len(best)), key=lambda i: (best[i], -i), default=-1)
    out = []
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def of_file(rows: list) -> Iterator[tuple]:
    """What a file's rows give: its sections, each question's answer with its places, suggestions, and questions that have no
    section.

    A section ends before the next header of the path or the next place that looks like a header, but not within its own header.
    Questions of the same title all get its fragments.
    """
    parts: dict[int, list] = {kind: [] for kind in (QUESTION, RESOLVED, FRAGMENT)}
    for r in rows:
        parts[r.part].append(r)
    key, questions, fragments = rows[0].key, [(r.ord, r.text, r.lower, r.root, r.child) for r in parts[QUESTION]], parts[FRAGMENT]
    row = lambda what, **x: (key, what, *map(x.get, GIVEN))
    if key is None:
        fragments, questions = [], [(None, *q[1:]) for q in questions]
    exam, resolved = Exam(questions), {}
    for r in parts[RESOLVED]:
        if r.ord is not None:
            resolved[r.text] = min(r.ord, resolved.get(r.text, r.ord))
    found = list(candidates(exam, [(r.text, r.kind) for r in fragments], resolved, _trust(rows)))
    certain = [(i, c) for i, c in found if c.sure]
    chain = [certain[j] for j in best_path([i for i, _ in certain], [c.until for _, c in certain], [c.ord for _, c in certain], [c.score for _, c in certain])]
    stops, stop = {}, len(fragments)  # of each place the next one that looks like a header
    for i, c in reversed(found):
        stops[i] = stop
        if c.score >= SURE or (fragments[i].kind == "heading" and c.score >= LIKELY):
            stop = i
    places: dict[int, set[int]] = {}
    for n, (i, c) in enumerate(chain):
        end = min(chain[n + 1][0] if n + 1 < len(chain) else len(fragments), max(stops[i], c.until))
        yield row("section", anchor=i, until=c.until, end=end, ord=c.ord, title=c.title, method=c.method)
        for twin in {o for lower in exam.lower.get(c.ord, ()) for o in exam.twins[lower]}:
            places.setdefault(twin, set()).update(range(c.until, end))
    for ord_, at in places.items():
        if at:
            yield row("answer", ord=ord_, places=list(dict.fromkeys(fragments[j].pos for j in sorted(at))), text="\n".join(fragments[j].text.strip(" ") for j in sorted(at)))
    hints: dict[int, tuple] = {}
    for i, c in found:
        if not c.sure and c.ord not in places and (c.ord not in hints or c.score > hints[c.ord][1]):
            hints[c.ord] = i, c.score, c.title
    for ord_, (i, score, title) in hints.items():
        yield row("suggestion", anchor=i, ord=ord_, title=title, score=score)
    for r in parts[QUESTION]:
        if r.ord not in places:
            yield row("missing", ord=r.ord)


@dataclass(frozen=True)
class Linked:
    sections: DataFrame  # key, anchor, until, end, ord, title, method
    bindings: DataFrame  # key, pos, ord, origin (auto or manual)
    answers: DataFrame  # key, ord, action (create, preserve), text
    suggestions: DataFrame  # key, ord, anchor, title, score: questions without a section, with their best uncertain header
    missing: DataFrame  # key, ord


def linked(fragments: DataFrame, questions: DataFrame, resolved: DataFrame, manual: DataFrame, edited: DataFrame) -> Linked:
    """Everything that a file's answers give. ``fragments`` has key, pos, text, kind; ``questions`` key, ord, title, root, child
    (its number; null if it has none); ``resolved`` key, form, ord; ``manual`` key, pos, ord (links by hand, which stay and
    aren't doubled); ``edited`` key, ord (answers by hand, which aren't overwritten).

    Files without a key link nothing.
    """
    rows = _dealt(fragments, questions, resolved)
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, what string, anchor int, until int, end int, ord {kinds['ord']}, title string, method string, score double, places array<{kinds['pos']}>, text string"
    given = shared.cut(groups.over(rows, ["key"], ["part", "pos"], of_file, schema))
    got = lambda what, *columns: given.where(F.col("what") == what).select("key", *columns)
    auto = got("answer", F.explode("places").alias("pos"), "ord").join(manual, ["key", "pos", "ord"], "left_anti")
    bindings = auto.withColumn("origin", F.lit("auto")).unionByName(manual.select("key", "pos", "ord").distinct().withColumn("origin", F.lit("manual")))
    filled = got("answer", "ord", "text").join(edited.select("key", "ord").distinct().withColumn("_e", F.lit(True)), ["key", "ord"], "left")
    answers = filled.select("key", "ord", F.when(F.col("_e"), "preserve").otherwise("create").alias("action"), "text")
    return Linked(got("section", "anchor", "until", "end", "ord", "title", "method"), bindings, answers, got("suggestion", "ord", "anchor", "title", "score"), got("missing", "ord"))
