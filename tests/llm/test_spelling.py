"""Near words against comparing all pairs, and the query against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillwork.llm import catalog, spelling


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 97 == 0:
                i = h % len(w)
                w = w[:i] + w[i + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    """Near words by their common deletions, all compared."""
    by = {}
    for w in n:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(key, []).append(w)
    near = {w: set() for w in n}
    for group in by.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if one_apart(a, b):
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()))


def test_near_words_against_all_pairs(spark):
    rng = random.Random(11)
    words = set()
    for alphabet, sizes in (("ab", (5, 6, 7)), ("aeiéÿ", (5, 6)), ("xyz×æc", (5, 6, 8)), (spelling.LETTERS, (5, 9))):
        words |= {"".join(rng.choices(alphabet, k=rng.choice(sizes))) for _ in range(250)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "b" * 40, "b" * 41, "zzzzzzzz"}
    for w in list(words)[:150]:
        i, c = rng.randrange(len(w)), rng.choice(spelling.LETTERS)
        words |= {x for x in (w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :]) if len(x) >= 5}
    n = {w: rng.choice([3, 4, 6, 8, 16, 40, 100]) for w in sorted(words)}
    assert result(spelling.grouped(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_chains_are_followed_to_the_last(spark):
    n = {"aaaaa" + "b" * i: 3 * 2**i for i in range(14)}
    rows = result(spelling.grouped(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert rows == brute(n) and {r[2] for r in rows} == {"aaaaa" + "b" * 13}


def test_one_edit_leaves_a_band(spark):
    words = ["kitten", "sitten", "kittens", "itten", "kïtten"]
    rows = spark.createDataFrame([(w, 3) for w in words], "word string, n long").select("word", F.expr(spelling._mask()).alias("m")).collect()
    mask = {r.word: r.m & (1 << 64) - 1 for r in rows}
    for w in words:
        want = 0
        for c in w:
            want ^= 1 << spelling.bit(c)
        assert mask[w] == want and bin(want ^ mask["kitten"]).count("1") <= 2
    assert sum(spelling.band_bits(b) & (1 << 64) - 1 for b in range(3)) == (1 << 64) - 1


def test_odd_tables(spark):
    rows = [(1, "Straße straße STRAßE ÉTAGE étage", 1), (None, "étage etage etage etage etage", 2), (None, None, 3), (2, "", 4), (2, "", 4), (3, "ÉTAGE ÉTAGE 你好 ab1cd", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = result(spelling.grouped(spelling.vocabulary(spelling.slips(docs))))
    assert got == brute(counted([(i, t) for i, t, _ in rows]))
    assert result(spelling.grouped(spelling.vocabulary(spelling.slips(docs.where("1 = 0"))))) == []
    slipped = [r.word for r in spelling.slips(docs, one_in=1).collect()]
    assert sum(len(w) for w in slipped) == sum(len(r.word) for r in spelling.slips(docs).collect()) - sum(len(w) >= 5 for i, t, _ in rows if i for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_python(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert result(catalog.QUERIES["op13_spelling_variants"](spark, d)) == brute(counted([tuple(r) for r in docs]))
