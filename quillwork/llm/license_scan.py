"""License scans by diagonal voting.

All rolling K-word hashes of all texts are joined with the positions at which license templates have them. A hit votes for
the diagonal (word place in the text less word place in the template) on which text and template run side by side; votes
are summed by diagonal before anything is grouped by text. Neighbouring diagonals, which insertions and deletions set
apart, are merged, and a merged span stands if the template words that its hits cover are enough of the template.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# The contract's base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Passages by which licenses are known, as their texts have them.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version.""",
    "agpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
}
# Notices of one line, and what Creative Commons licenses are called.
NOTICES = {
    "mit": ("Released under the MIT License", "Licensed under the MIT License"),
    "apache": ("Licensed under the Apache License, Version 2.0",),
    "gpl": ("Licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 3"),
    "lgpl": ("Licensed under the GNU Lesser General Public License",),
    "agpl": ("Licensed under the GNU Affero General Public License",),
    "mpl": ("Licensed under the Mozilla Public License, version 2.0",),
    "bsd": ("Licensed under the BSD 3-Clause License", "Licensed under the BSD 2-Clause License"),
    **{f"cc-{x.lower()}": tuple(f"Licensed under CC {x} {v}" for v in ("2.0", "3.0", "4.0")) for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
}
#: Words of a hash, diagonals apart that still merge, the least matched share of a template, and of its words (a template
#: of fewer words must be matched whole).
K, APART, SHARE, LEAST = 4, 8, 0.3, 12


def known_templates() -> list[tuple[str, str]]:
    """Labels and texts of all templates."""
    return [*TEMPLATES.items(), *((label, text) for label, texts in NOTICES.items() for text in texts)]


def template_grams(templates: list[tuple[str, str]], k: int = K) -> list[tuple[str, int, int, int]]:
    """(template, words, place, hash) of every run of ``k`` words in every template: a table that no corpus enlarges."""
    out = []
    for i, (_, text) in enumerate(templates):
        w = common.word_table([text.encode()])
        h, at = common.grams(w.hash, w.doc, k)
        out += [(i, len(w.start), int(a), int(x)) for x, a in zip(h.view(np.int64), at, strict=True)]
    return out


def _phrases(w: common.Words) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of the base phrases: which, and at what word (index within the slice), in order of place."""
    names, which, where = list(PHRASES), [], []
    for i, phrase in enumerate(names):
        p = common.word_table([phrase.encode()])
        h, n = p.hash, len(p.start)
        ok = np.flatnonzero(w.hash[: max(0, len(w.hash) - n + 1)] == h[0])
        for j in range(1, n):
            ok = ok[w.hash[ok + j] == h[j]]
        ok = ok[w.doc[ok] == w.doc[ok + n - 1]] if len(ok) else ok
        which.append(np.full(len(ok), i))
        where.append(ok)
    which_, where_ = np.concatenate(which), np.concatenate(where)
    order = np.argsort(where_, kind="stable")
    return names, which_[order], where_[order]


def _words(batches: Iterator[pa.RecordBatch], known: np.ndarray, k: int = K) -> Iterator[pa.RecordBatch]:
    """By row: counts, base phrases, hashes of all runs of ``k`` words, and the text again if one of these is in ``known``."""
    for batch in batches:
        texts = common.strings(batch.column(1))
        for at, raw in common.slices(texts):
            w, n = common.word_table(raw), len(raw)
            words = np.bincount(w.doc, minlength=n)
            base = np.concatenate([[0], np.cumsum(words)])[:-1]
            grams, _ = common.grams(w.hash, w.doc, k)
            ends = np.cumsum(np.maximum(words - k + 1, 0))
            hit = np.diff(np.concatenate([[0], np.cumsum(np.isin(grams, known))])[np.concatenate([[0], ends])]) > 0
            names, which, where = _phrases(w)
            doc = w.doc[where]
            place, cut = where - base[doc], np.searchsorted(doc, np.arange(n + 1))
            number = np.diff(cut)
            first, last = (pa.array([int(place[x]) if m else None for x, m in zip(c, number, strict=True)], pa.int64()) for c in (cut[:-1], cut[1:] - 1))
            labels = [sorted({PHRASES[names[x]] for x in which[a:b]}) for a, b in zip(cut, cut[1:])]
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(words.astype(np.int64)), pa.array(number.astype(np.int64)), first, last,
                pa.array(labels, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams.view(np.int64))),
                pa.array([t if h else None for t, h in zip(texts[at : at + n], hit, strict=True)], pa.string())],
                names=["row", "key", "n_words", "n_base", "first_word", "last_word", "base", "grams", "said"])


def spans(hits: DataFrame, apart: int = APART, k: int = K) -> DataFrame:
    """Merged diagonals of ``hits`` (row, template, words, place, at): row, template, start, end, diagonals and votes.

    ``place`` is the word in the text and ``at`` in the template. Votes are counted by diagonal first. Diagonals that are at
    most ``apart`` from the next one are neighbours; of these, each that begins before all earlier ones have been over for
    four times ``apart`` words joins them. Diagonals far off, which passages make that a template repeats, stay by themselves.
    """
    diagonal = F.col("place") - F.col("at")
    voted = hits.groupBy("row", "template", "words", diagonal.alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("place").alias("start"), (F.max("place") + k).alias("end"))
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > apart), F.lit(True)).cast("int")
    banded = voted.withColumn("_near", near).withColumn("band", F.sum("_near").over(by_diagonal))
    by_place = Window.partitionBy("row", "template", "band").orderBy("start", "diagonal")
    over = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") - over > 4 * apart, F.lit(True)).cast("int")
    chained = banded.withColumn("_fresh", fresh).withColumn("chain", F.sum("_fresh").over(by_place))
    return chained.groupBy("row", "template", "words", "band", "chain").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("votes").alias("votes"), F.sort_array(F.collect_list("diagonal")).alias("diagonals")).drop("band", "chain")


def matched(text: common.Words, template: common.Words, start: int, end: int, diagonals: list[int]) -> int:
    """Template words that stand, byte for byte, where one of the diagonals puts them between two words of the text."""
    at = np.concatenate([np.arange(max(0, start - d), min(len(template.start), end - d)) for d in diagonals])
    place = at + np.repeat(diagonals, [max(0, min(len(template.start), end - d) - max(0, start - d)) for d in diagonals])
    same = common.same_spans(text.data, text.start[place], text.end[place], template.data, template.start[at], template.end[at])
    return len(np.unique(at[same]))


def _apart(found: list[tuple]) -> list[tuple]:
    """Of spans that overlap, the one with most matched words (then the largest share); in order of label and place."""
    kept: list[tuple] = []
    places: list[tuple[int, int]] = []  # of the kept ones, in order
    for x in sorted(found):
        i = bisect.bisect(places, (x[3], x[4]))
        if (i == 0 or places[i - 1][1] <= x[3]) and (i == len(places) or places[i][0] >= x[4]):
            places.insert(i, (x[3], x[4]))
            kept.append(x)
    return sorted(kept, key=lambda x: x[2:])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: identifier, n_words, n_base, first_word, last_word, base (labels), found (spans: label,
    start, end in words, score as the share of the template's words that stand there; of those that overlap the best).

    Words are lower-cased in A-Z only. Null texts count as empty; a text shorter than K words has no hashes. Repeated rows
    get a row each, other columns aren't looked at, no rows give no rows. Every row's hashes are joined where they are; only
    hits move, and the texts that have some. A hit knows its row by identifier and text, so a task that runs again finds the
    same ones.
    """
    spark = docs.sparkSession
    common.tune(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"), F.xxhash64(text).alias("_key"))
    kind = dict(rows.dtypes)[id_col]
    texts = list(templates.items()) if templates else known_templates()
    table = template_grams(texts)
    in_templates = np.array([x for *_, x in table], np.int64).view(np.uint64)
    schema = f"row {kind}, key bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, grams array<bigint>, said string"
    words = rows.mapInArrow(lambda batches: _words(batches, in_templates), schema)
    known = spark.createDataFrame(table, "template int, words bigint, at bigint, gram bigint")
    hits = words.select("row", "key", F.posexplode("grams").alias("place", "gram")).join(F.broadcast(known), "gram")
    hits = hits.select(F.struct("row", "key").alias("row"), "template", "words", F.col("place").cast("bigint").alias("place"), "at").distinct()
    enough = F.least(F.lit(LEAST), F.col("words"))
    likely = spans(hits).where(F.col("end") - F.col("start") >= F.greatest(enough, SHARE * F.col("words")) - APART)
    each = likely.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("template", "start", "end", "diagonals"))).alias("likely"))
    each = each.select(F.col("row.row").alias("_r"), F.col("row.key").alias("_k"), "likely")
    joined = words.drop("grams").join(each, F.col("row").eqNullSafe(F.col("_r")) & (F.col("key") == F.col("_k")), "left").drop("_r", "_k", "key")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [common.word_table([t.encode()]) for _, t in texts]
        kind_of = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            found: list[list[dict] | None] = []
            for said, spans_ in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                kept = []
                w = common.word_table([said.encode("utf-8", "surrogatepass")]) if spans_ else None
                for x in spans_ or []:
                    t = tables[x["template"]]
                    n, size = matched(w, t, x["start"], x["end"], x["diagonals"]), len(t.start)
                    if n >= min(LEAST, size) and n >= SHARE * size:
                        kept.append((-n, -n / size, texts[x["template"]][0], x["start"], x["end"]))
                found.append([{"label": label, "start": a, "end": b, "score": -score} for _, score, label, a, b in _apart(kept)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(found, kind_of)], names=[*batch.schema.names[:6], "found"])

    out = f"row {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, found array<struct<label:string,start:bigint,end:bigint,score:double>>"
    return joined.select("row", "n_words", "n_base", "first_word", "last_word", "base", "said", "likely").mapInArrow(verified, out).withColumnRenamed("row", id_col)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and verified spans of all documents. Null and empty texts have no words, labels or spans and a score of 0; of
    spans that overlap the one with most matched words counts; repeated rows get a row each; an empty table gives none."""
    found = scan(common.table(spark, sf_dir, "documents"))
    more = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                        F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"),
                        F.greatest(best, F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
                        F.coalesce(F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"])), ","), F.lit("")).alias("spans"))
