"""Personal data by patterns and by a linear-chain conditional random field over word shapes.

The field's tokens are what white space separates; its features are hashes of a token's shape without the marks around it
(digits, capitals, small letters, other characters as they are), in full and with repeated characters dropped, of how many
digits it has, of its neighbours' shapes, and of the word before it. It is fitted by gradient ascent on the exact conditional likelihood of a small labelled table, and decoded
by Viterbi in numpy over padded batches of sentences; in long ones the state is carried over from block to block. What it finds beside the patterns' spans is checked for the digits or
marks that its kind must have.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The contract's kinds and patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The field's tags: outside, one-token kinds, and first and further tokens of kinds of several.
TAGS = ("O", "B-email", "B-ip", "B-card", "I-card", "B-phone", "I-phone", "B-ssn")
#: Labelled rows: a span is written [kind:text], all else is outside.
LABELLED = """
Please call [phone:+1 (415) 555-0134] before noon .
You can reach the desk at [phone:(212) 555-0199] today .
Her number is [phone:555-867-5309-22] , ask for the manager .
Fax [phone:+44 20 7946 0958] or write to us .
Tel. [phone:030 901820 4455] in the morning
Ring [phone:(650) 253 0000] after the meeting has ended .
The office ( [phone:+49 30 1234 5678] ) is closed on Monday .
phone: [phone:1-800-555-0100] ext four
Mobile [phone:0171 5550 1234] works as well
Contact [email:jane.doe@example.com] for details .
Send it to [email:info@mail.example.org] and wait .
[email:max_mustermann@firma.example.de] wrote this on Tuesday .
Email: [email:a.b-c@uni.example.edu] , office 12
From [email:root@localhost.example] to all
The server [ip:192.168.10.254] did not answer .
Connect to [ip:10.0.0.17] over port 8080 .
host [ip:172.16.254.1] was added in version 2.4.1
Address [ip:8.8.4.4] resolves names .
Card [card:4111 1111 1111 1111] expires 12/27 .
Charge [card:5500-0000-0000-0004] for the order .
Visa [card:4012888888881881] was declined .
Pay with [card:3782 822463 10005] please
The card number [card:6011 0009 9013 9424] is on file .
His SSN is [ssn:078-05-1120] as filed .
social security [ssn:219-09-9999] on the form
ssn: [ssn:457-55-5462]
The meeting is on 2024-05-17 at 10:30 in room 204 .
In 1998 there were 1,204,331 people and 17 schools .
Version 3.11.2 fixes bug 48213 and bug 50177 .
It costs 19.99 or 25 euros , not 1.250,00 .
See pages 117-129 and table 4 of part II .
Isbn 978-3-16-148410-0 is the second edition .
The lat is 52.5200 and the long is 13.4050 , about 34 m high .
Nothing to see here , move along and read the next line .
The and with that thereon , as it was for the other of them .
Und die Straßen waren leer ; niemand kam , niemand ging .
Les élèves étaient déjà là , mais le maître ne venait pas .
Los niños y las niñas corrieron hacia la plaza mayor .
THE END OF PART ONE !! AND THEN SOME !! MORE !! TEXT !!
a | b | c | d12 | e-34 | f_56 | 7g
%%% to*** ting$$$ ther### and&&& reble###
Orders 10023 , 10024 and 10025 were shipped in 3 boxes .
Ref. AB-12-99 , lot 2023/117-A , qty 40
The score was 3-2 after 90 minutes , 21-19 in 2011-2012 .
step 1 . mix 200 g flour , 2 . add 3 eggs , 3 . bake at 180
user_42 logged in from host-7 at 12:44:59.120
oneth ored [phone:(415) 555-2671] that is of the ingly
the mention et [phone:212-555-0187]!! la ville aussi
und dann [phone:303.555.0142] achtung bitte
inger, [phone:(907) 555-0162]&&& there### was
call or text [phone:1 (800) 555-0175] any time of day
asked for [phone:089 1234 5678], but nobody answered
numéro [phone:01 42 68 53 00] pour la mairie
teléfono [phone:91 555 01 23] de la oficina
thanon [phone:+1 (663) 555-6869] aresthe on
the [phone:+1 (830) 555-5433]%%% therwh
dende [email:hein.19@mail5.example.com] ining that
of it [email:that.92@mail2.example.com]### the&&& and
[email:onbest.54@web3.example.net] der und die
ned, [email:k.lee-7@dept.example.co.uk], wrote to us
las [email:an.07@post2.example.org] en la
was, [email:li.33@mx4.example.com]&&& en%%% der
inthat [ip:174.91.180.241] erst noch
THE !! [ip:233.233.171.252]!! HETHON ,!! ON
oner [ip:70.23.22.57]&&& éouen le
la le [ip:227.5.221.1] de la
mente ramiar, [card:4539578763621486] de que
of and [card:4485275742308327]%%% in there
sent [card:5105 1051 0510 5100], which failed
thon [card:3714-496353-98431] is on the list
number [ssn:123-45-6789] was on the letter
thereon [ssn:321-54-9876]### and&&& so
of [ssn:536-22-8712], by the office
build 20240517 of release 7.1.0.3 passed
sum 4465758 and 12345678901 of rows
at 52.3702 , 4.8952 or 10.0.0 in all
time 12:30-13:45 and 14:00-15:30 on 03/04/2021
isbn 0-306-40615-2 and 978-0-306-40615-7 , doi 10.1000/182
room 12-34 , part 555-B , code 4711-0815 in store
lines 100-200 , 300-400 and 500-600 of file 12.txt
ratio 3:2 , sizes 10x20x30 and 1.5 by 2.5
ththe$$$ oron###, 42!! 17%%% 2001&&& and@the
"""
SIZE, STEPS, RATE, DECAY = 1 << 12, 220, 0.25, 2e-3
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = 100
_SHAPE[65:91] = 88
_SHAPE[97:123] = 120
_SHAPE[128:] = 120
_STRIP = ".,;:!?\"'<>[]{}#$%&*|"
_AROUND = np.zeros(256, bool)
_AROUND[list(_STRIP.encode())] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes; where texts start; tokens' starts and ends; their sequences; their features (one row a token)."""
    data, first = common.joined(raw)
    start, end = common.runs(~_SPACE[data])
    n = len(start)
    if not n:
        return data, first, start, end, np.zeros(0, np.int64), np.zeros((0, 7), np.int64)
    doc = np.searchsorted(first, start, side="right") - 1
    shape = _SHAPE[data]
    # A token's core is what is left without the marks around it, if anything is.
    solid = np.flatnonzero(~(_SPACE | _AROUND)[data])
    at = np.searchsorted(solid, np.stack([start, end]))
    has = at[0] < at[1]
    a, b = start.copy(), end.copy()
    a[has], b[has] = solid[at[0][has]], solid[at[1][has] - 1] + 1
    keep = np.concatenate([[True], shape[1:] != shape[:-1]])
    keep[a] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    brief = common.span_hashes(shape[keep], place[a], place[b])
    full = common.span_hashes(shape, a, b)
    digits = np.concatenate([[0], np.cumsum(shape == _SHAPE[48])])
    number = ((digits[b] - digits[a]) << 2 | (b - a > 24)).astype(np.uint64)
    word = common.span_hashes(common.LOWER[data], start, end)
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    closing = np.isin(data[end - 1], [33, 46, 63])
    fresh[1:] |= closing[:-1] & ((end - start)[:-1] > 1)
    lines = np.concatenate([[0], np.cumsum(data == 10)])[start]
    fresh[1:] |= lines[1:] != lines[:-1]
    sequence = np.cumsum(fresh) - 1
    edge = np.uint64(0x1234567)
    before = np.concatenate([[edge], brief[:-1]])
    before[fresh] = edge
    after = np.concatenate([brief[1:], [edge]])
    after[:-1][fresh[1:]] = edge
    said = np.concatenate([[edge], word[:-1]])
    said[fresh] = edge
    salted = [common.mix(x + np.uint64(i * 7919)) >> np.uint64(52) for i, x in enumerate((brief.copy(), full, before, after, said, brief * np.uint64(31) + before, number))]
    return data, first, start, end, sequence, np.stack(salted, axis=1).astype(np.int64) % SIZE


def _parsed(rows: str) -> list[tuple[bytes, list[int]]]:
    out = []
    for line in rows.strip().splitlines():
        words, tags = [], []
        for kind, text, plain in re.findall(r"\[(\w+):([^\]]+)\]|(\S+)", line):
            span = text.split() if kind else [plain]
            words += span
            tags += [TAGS.index(f"{'B' if i == 0 else 'I'}-{kind}") if kind else 0 for i in range(len(span))]
        out.append((" ".join(words).encode(), tags))
    return out


@functools.cache
def fit(rows: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and of transitions, by gradient ascent on the exact likelihood (forward and backward sums)."""
    k = len(TAGS)
    table = []
    for raw, tags in _parsed(rows):
        _, _, _, _, sequence, feature = _tokens([raw])
        for s in range(sequence[-1] + 1):
            at = np.flatnonzero(sequence == s)
            table.append((feature[at], np.array(tags)[at]))
    w, t = np.zeros((SIZE, k)), np.zeros((k, k))
    for a in range(k):
        for b in range(k):
            if TAGS[b][0] == "I" and TAGS[a][2:] != TAGS[b][2:]:
                t[a, b] = -1e4  # a further token follows its own kind
    free = t == 0
    # All sequences side by side, padded at their ends.
    length = np.array([len(tags) for _, tags in table])
    live = np.arange(length.max()) < length[:, None]
    last = (np.arange(len(table)), length - 1)
    features = np.concatenate([f for f, _ in table])
    said = np.zeros((*live.shape, k))
    said[live] = np.eye(k)[np.concatenate([tags for _, tags in table])]
    steps = np.einsum("sia,sib->ab", said[:, :-1], said[:, 1:])
    inside = [i for i, x in enumerate(TAGS) if x[0] == "I"]
    gw2, gt2 = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    for _ in range(STEPS):
        e = np.zeros_like(said)
        e[live] = w[features].sum(axis=1)
        e[:, 0, inside] = -1e4
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for i in range(1, e.shape[1]):
            alpha[:, i] = e[:, i] + np.logaddexp.reduce(alpha[:, i - 1, :, None] + t, axis=1)
        for i in range(e.shape[1] - 2, -1, -1):
            beta[:, i] = np.where(live[:, i + 1, None], np.logaddexp.reduce(t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(alpha[last], axis=1)[:, None, None]
        gw = np.zeros_like(w)
        np.add.at(gw, features, (said - np.exp(alpha + beta - z))[live][:, None, :])
        both = np.exp(np.minimum(0, alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - z[..., None])) * live[:, 1:, None, None]
        gw -= DECAY * len(table) * w
        gt = np.where(free, steps - both.sum(axis=(0, 1)) - DECAY * len(table) * t, 0)
        gw2 += gw * gw
        gt2 += gt * gt
        w += RATE * gw / np.sqrt(gw2)
        t += RATE * gt / np.sqrt(gt2)
    return w.astype(np.float32), t.astype(np.float32)


#: Tokens that are decoded at once; longer sequences are decoded in blocks of as many.
BLOCK = 64


def _best(e: np.ndarray, t: np.ndarray, head: np.ndarray, length: np.ndarray, first: np.ndarray, last: np.ndarray | None, out: np.ndarray) -> None:
    """Writes the best tags of runs of tokens, given the scores of their first tokens' tags and (or not) their last tags."""
    n, k = e.shape
    for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 40), (40, BLOCK)):
        rows = np.flatnonzero((length > low) & (length <= high))
        if not len(rows):
            continue
        steps = int(length[rows].max())
        back = np.zeros((steps, len(rows), k), np.int8)
        best = first[rows].copy()
        for i in range(1, steps):
            live = length[rows] > i
            both = best[:, :, None] + t
            back[i] = both.argmax(axis=1)
            new = np.take_along_axis(both, back[i][:, None, :].astype(np.intp), axis=1)[:, 0] + e[np.minimum(head[rows] + i, n - 1)]
            best = np.where(live[:, None], new, best)
            back[i][~live] = np.arange(k)
        tag = best.argmax(axis=1) if last is None else last[rows]
        for i in range(steps - 1, -1, -1):
            live = np.flatnonzero(length[rows] > i)
            out[head[rows[live]] + i] = tag[live]
            tag = back[i][np.arange(len(rows)), tag] if i else tag


def _carried(e: np.ndarray, t: np.ndarray, head: np.ndarray, length: np.ndarray, begin: np.ndarray, out: np.ndarray) -> None:
    """As ``_best`` for sequences of any length, over blocks: each block's best scores from any tag before it to any tag at
    its end, the best chain of these over a sequence, and then each block between the tags that the chain has."""
    n, k = e.shape
    size = -(-length // BLOCK)
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    start = np.repeat(head, size) + place * BLOCK
    held = np.minimum(np.repeat(head + length, size) - start, BLOCK)
    opens = place == 0
    whole = np.zeros((len(start), k, k), np.float32)
    for a in range(0, len(start), 4096):
        s, h = start[a : a + 4096], held[a : a + 4096]
        m = np.where(opens[a : a + 4096, None, None], np.repeat(begin, size, axis=0)[a : a + 4096, None, :], t + e[s][:, None, :])
        for i in range(1, int(h.max())):
            new = (m[:, :, :, None] + t).max(axis=2) + e[np.minimum(s + i, n - 1)][:, None, :]
            m = np.where((h > i)[:, None, None], new, m)
        whole[a : a + 4096] = m
    chain = np.zeros((len(start), k), np.int8)
    score = np.zeros((len(head), k), np.float32)
    for i in range(int(size.max())):
        live = np.flatnonzero(size > i)
        both = score[live, :, None] + whole[at[live] + i]
        chain[at[live] + i] = both.argmax(axis=1)
        score[live] = both.max(axis=1)
        score[live] -= score[live].max(axis=1, keepdims=True)
    tag = score.argmax(axis=1)
    before, last = np.zeros(len(start), np.intp), np.zeros(len(start), np.intp)
    for i in range(int(size.max()) - 1, -1, -1):
        live = np.flatnonzero(size > i)
        last[at[live] + i] = tag[live]
        tag[live] = chain[at[live] + i, tag[live]]
        before[at[live] + i] = tag[live]
    _best(e, t, start, held, np.where(opens[:, None], np.repeat(begin, size, axis=0), t[before] + e[start]), last, out)


def viterbi(e: np.ndarray, t: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """The best tag of each token; ``e`` has a row of scores a token, ``sequence`` numbers the sequences from 0."""
    out = np.zeros(len(e), np.int8)
    if not len(e):
        return out
    length = np.bincount(sequence)
    head = np.concatenate([[0], np.cumsum(length)[:-1]])
    begin = e[head].copy()
    begin[:, [x[0] == "I" for x in TAGS]] = -1e4
    _best(e, t, head, length, begin, None, out)
    long = np.flatnonzero(length > BLOCK)
    if len(long):
        _carried(e, t, head[long], length[long], begin[long], out)
    return out


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def _is_card(text: str) -> bool:
    d = _digits(text)
    return 13 <= len(d) <= 19 and luhn(d)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that don't overlap, found from their signs: what stands before a sign belongs to no other, so a text is
    read once, however long its runs of letters are."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost fours of numbers joined by points: of each chain of numbers the first four, the next four, and so on."""
    for chain in NUMBERS.finditer(text):
        parts, at = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(int(x[-9:]) <= 255 and not x[:-9].strip("0") for x in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The patterns' spans: kind's place, start, end; by kind and start."""
    out = [(0, *x) for x in _emails(text)] + [(1, *x) for x in _addresses(text)]
    out += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m[0])]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


#: What a span of the field must be to count.
CHECKS = {
    "email": re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+"), "ip": re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "phone": re.compile(r"[+(]?[0-9][0-9 ().-]*[0-9]"), "card": re.compile(r"[0-9][0-9 .-]*[0-9]"),
}


def _checked(kind: str, text: str) -> bool:
    if not CHECKS[kind].fullmatch(text):
        return False
    d = _digits(text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15 and len(re.findall(r"[0-9]+", text)) >= 3 and not (CHECKS["card"].fullmatch(text) and _is_card(text))
    return kind != "card" or _is_card(text)


def field_spans(raw: list[bytes], w: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
    """(text, kind, start, end) of the field's checked spans, in code points."""
    data, first, start, end, sequence, feature = _tokens(raw)
    e = np.zeros((len(start), len(TAGS)), np.float32)
    for j in range(feature.shape[1]):
        e += w[feature[:, j]]
    tag = viterbi(e, t, sequence)
    at = np.flatnonzero(tag)
    i = 0
    while i < len(at):
        j, kind = i + 1, TAGS[tag[at[i]]][2:]
        while j < len(at) and at[j] == at[j - 1] + 1 and TAGS[tag[at[j]]] == f"I-{kind}" and sequence[at[j]] == sequence[at[i]]:
            j += 1
        doc = int(np.searchsorted(first, start[at[i]], side="right")) - 1
        a, b = int(start[at[i]] - first[doc]), int(end[at[j - 1]] - first[doc])
        text = raw[doc][a:b].decode("utf-8", "replace")
        left = text.lstrip(_STRIP)
        a += len(text[: len(text) - len(left)].encode())
        left = left.rstrip(_STRIP)
        if _checked(kind, left):
            s = len(raw[doc][:a].decode("utf-8", "replace"))
            yield doc, kind, s, s + len(left)
        i = j


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: str = LABELLED) -> DataFrame:
    """One row per row of ``docs``: identifier, base and found: arrays of spans (kind, start, end) in code points.

    ``found`` has the field's spans that meet no pattern's span. Null texts count as empty and have none. Whole texts are
    read; rows are scanned alone, repeated ones alike; other columns aren't looked at; no rows give no rows.
    """
    common.tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled))  # SIZE rows of len(TAGS) numbers
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = model.value
        for batch in batches:
            texts = common.strings(batch.column(1))
            base = [base_spans(x) for x in texts]
            more: list[list[tuple[str, int, int]]] = [[] for _ in texts]
            for at, raw in common.slices(texts):
                for doc, kind, a, b in field_spans(raw, w, t):
                    if all(b <= s or a >= e for _, s, e in base[at + doc]):
                        more[at + doc].append((kind, a, b))
            rows = ([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in x] for x in base], [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in more])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, kind_of) for r in rows)], names=["id", "base", "found"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, base {spans}, found {spans}").withColumnRenamed("id", id_col)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents. Null and empty texts have none (the digest is that of nothing); repeated rows get equal spans; an
    empty table gives no rows."""
    found = scan(common.table(spark, sf_dir, "documents"))
    order = F.array(*map(F.lit, (*KINDS, "ssn")))

    def said(spans):
        placed = F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(order, x["kind"]).alias("k"), x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("n"))))
        return F.array_join(F.transform(placed, lambda x: F.concat_ws(":", x["n"], x["s"], x["e"])), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.concat("base", "found")).alias("spans"))
