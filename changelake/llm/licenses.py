"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined with those of a fixed list of license templates. A match at word p of a document and
word t of a template votes for the diagonal p - t. Votes are summed for each document, template and diagonal before any shuffle; neighbouring
diagonals, as insertions and omissions leave them, are merged into spans, and a span counts if its matches cover enough of the template.
Every match is verified on the words themselves, not only on their hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelake.llm.frames import slices, texts_of
from changelake.llm.words import Words

K = 4
#: Votes may lie this many diagonals, and this many words, apart and still be of one span.
DRIFT, GAP = 4, 24
#: A span counts from this share of the template's k-grams on.
COVER = 0.6
#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wording of widely used license notices, from the licenses' own texts, by label.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at""",
        """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "mit": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
}
SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str) -> list[str]:
    """The words of a text with A to Z lower-cased: runs of digits, letters and characters beyond ASCII."""
    return SPLIT.findall(text.translate(UPPER))


def _hashes(words: Words, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    at, h = words.grams(tuple(range(k)), 7)
    return at, h.view(np.int64)


def known_grams(k: int = K) -> list[tuple[int, str, int, int, str]]:
    """(template, label, grams, place, wording) of the fixed list: a template's number, label and k-grams, and where each stands and how it reads."""
    rows, number = [], 0
    for label, texts in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            rows += [(number, label, len(words) - k + 1, p, " ".join(words[p : p + k])) for p in range(len(words) - k + 1)]
            number += 1
    return rows


def templates(spark: SparkSession, k: int = K) -> DataFrame:
    """The rows of `known_grams` with their hashes h: several hundred, whatever the corpus."""
    rows = known_grams(k)
    hashes = [int(_hashes(Words([w.encode()]), k)[1][0]) for *_, w in rows]
    return spark.createDataFrame([(h, *r) for h, r in zip(hashes, rows, strict=True)], "h long, template int, label string, grams int, place int, wording string")


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = [(p.split(), label) for p, label in BASE]
    clue = re.compile("|".join(p.split()[-1] for p, _ in BASE))
    for batch in slices(batches, "text"):
        lowered = [t.translate(UPPER) for t in texts_of(batch.column(2))]
        words = Words([t.encode("utf-8", "surrogatepass") for t in lowered])
        at, h = _hashes(words)
        first = words.first
        bounds = np.searchsorted(at, first)
        starts, ends = words.start, words.end
        n_base, low, high, labels = [], [], [], []
        for i, t in enumerate(lowered):
            places, found = [], set()
            if clue.search(t):
                w = SPLIT.findall(t)
                for j, x in enumerate(w):
                    for phrase, label in phrases:
                        if x == phrase[0] and w[j : j + len(phrase)] == phrase:
                            places.append(j)
                            found.add(label)
            n_base.append(len(places))
            low.append(min(places) if places else None)
            high.append(max(places) if places else None)
            labels.append(sum(1 << b for b, (_, label) in enumerate(BASE) if label in found))
        local = at - np.repeat(first[:-1], np.diff(bounds))
        spans = pa.StructArray.from_arrays(
            [pa.array(local), pa.array(h), pa.array(starts[at].astype(np.int32)), pa.array((ends[at + K - 1] - starts[at]).astype(np.int32))], names=["p", "h", "from", "size"]
        )
        out = [batch.column(0), batch.column(1), pa.array([t.encode("utf-8", "surrogatepass") for t in lowered], pa.binary()), pa.array(np.diff(first)), pa.array(n_base, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
        out += [pa.array(labels, pa.int32()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans)]
        yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "low", "n_words", "n_base", "first_word", "last_word", "base", "grams_"])


def scan(docs: DataFrame) -> DataFrame:
    """License labels of every row of `docs` (doc_id, text), with base phrases and the spans that diagonal voting finds.

    Returns doc_id, n_words, n_base, first_word, last_word, base (array of labels), labels (base ones and those of spans), score (the
    best span's share of its template's k-grams, 1 with a base phrase, 0 without any) and spans (array of label, first word, last word, cover). A null
    text is empty; texts shorter than a k-gram have base phrases at most. Each row is a document of its own, repeated rows and null ids too.
    An empty table gives an empty one.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = (
        "row long, doc_id long, low binary, n_words long, n_base long, first_word long, last_word long, base int, grams_ array<struct<p: long, h: long, `from`: int, size: int>>"
    )
    made = numbered.mapInArrow(_prepare, schema)
    head = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    grams = made.select(*head, "low", F.explode_outer("grams_").alias("g")).select(*head, "low", F.col("g.p").alias("p"), F.col("g.h").alias("h"), F.col("g.from").alias("from"), F.col("g.size").alias("size"))
    known = F.broadcast(templates(docs.sparkSession))
    # The words are compared as the template spells them: any run of other signs stands for one space.
    wording = F.regexp_replace(F.decode(F.substring("low", F.col("from") + 1, F.col("size")), "utf-8"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    met = grams.join(known, "h", "left").withColumn("hit", F.when(F.col("wording").isNotNull(), wording == F.col("wording")))
    hit = F.coalesce("hit", F.lit(False))
    own = [F.when(hit, F.col(c)).alias(c) for c in ("template", "p", "place")]
    votes = met.select(*head, *own).withColumn("diagonal", F.col("p") - F.col("place"))
    # All buffers have a fixed width, so that votes are hashed and summed where they arise: a template's places are the bits of as many longs as the longest needs.
    longs = [f"places{n}" for n in range(-(-max(g for _, _, g, _, _ in known_grams()) // 64))]
    places = [F.bit_or(F.expr(f"if(place div 64 = {n}, shiftleft(1L, place % 64), 0L)")).alias(c) for n, c in enumerate(longs)]
    tallied = votes.groupBy("row", "template", "diagonal").agg(*(F.first(c).alias(c) for c in head[1:]), F.min("p").alias("from"), F.max("p").alias("to"), *places)
    order = Window.partitionBy("row", "template").orderBy("diagonal", "from")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT) | (F.col("from") > F.lag("to").over(order) + GAP) | (F.col("to") < F.lag("from").over(order) - GAP)
    parted = tallied.withColumn("part", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    spans = parted.groupBy("row", "template", "part").agg(
        *(F.first(c).alias(c) for c in head[1:]), F.min("from").alias("from"), (F.max("to") + K - 1).alias("to"), reduce(add, (F.bit_count(F.bit_or(c)) for c in longs)).alias("covered")
    )
    kinds = F.broadcast(known.groupBy(F.col("template").alias("kind")).agg(F.first("label").alias("label"), F.first("grams").alias("grams")))
    rated = spans.join(kinds, F.col("template") == F.col("kind"), "left").withColumn("cover", F.col("covered") / F.col("grams"))
    good = F.when(F.col("cover") >= COVER, F.struct("label", "from", "to", "cover"))
    found = rated.groupBy("row").agg(
        *(F.first(c).alias(c) for c in head[1:]), F.array_sort(F.collect_list(good)).alias("spans"), F.coalesce(F.max(F.when(F.col("cover") >= COVER, F.col("cover"))), F.lit(0.0)).alias("best")
    )
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.col("base").bitwiseAND(1 << b) != 0, F.lit(label)) for b, (_, label) in enumerate(BASE)))))
    labels = F.array_sort(F.array_union(base, F.array_distinct(F.transform("spans", lambda s: s["label"]))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("best"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", base.alias("base"), labels.alias("labels"), score.alias("score"), "spans")
