"""License notices by MinHash bands over overlapping windows.

Texts and templates become lower-cased words of letters and digits and
hashes of five-word shingles. A template's shingles are cut to units of at
most ``UNIT`` shingles. For each unit there is a window length (the next of
``WINDOWS``), and a document's windows of that length overlap by three
quarters, so some window holds the unit but for less than a quarter of the
window. Each of ``BANDS`` bands of one row keeps the minimum of a permuted
hash over a window; a window retrieves a unit when a band agrees.

With one row a band, two sets of similarity ``s`` agree somewhere with
probability ``1 - (1 - s) ** BANDS``: above 0.98 at the lowest similarity
that a notice kept to three quarters can have to a window of its length
class (:func:`collision_probability`).

A band can only agree where the unit's minimal shingle stands in the
window, so bands are computed for windows around such shingles alone; no
other window has a key that joins. Retrieved pairs are verified exactly:
the share of the template's shingles that the document contains must reach
0.75.

All steps are DataFrame functions inside a document's own row: nothing is joined
or shuffled. Work is linear in a text's words and in the notices it holds, as each
place looks at no more than a window to either side.

Edge cases: other columns are not read; NULL and empty texts hold nothing; a template or text of fewer
than five words is one shingle; repeated rows are reported each; templates
repeated under one name count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
UNIT = 64
WINDOWS = (4, 8, 16, 32, 64)  # shingles
BANDS = 24
SIMILARITY = 0.75

# Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "BSD-3-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
}


def collision_probability(similarity: float, bands: int = BANDS) -> float:
    return 1 - (1 - similarity) ** bands


def _hashed_words(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(h: Column) -> Column:
    """``h`` must be a column: it is read at every place."""
    last = F.greatest(F.size(h) - SHINGLE, F.lit(0))
    return F.when(F.size(h) > 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
    ).otherwise(F.array().cast("array<long>"))


def with_shingles(df: DataFrame, text_col: str, keep: list[Column], out: str) -> DataFrame:
    """``keep`` and the shingle hashes; a generator holds the word hashes, so
    that no optimiser rule copies their computation into the shingles'."""
    h = df.select(*keep, F.explode(F.array(F.coalesce(_hashed_words(F.col(text_col)),
                                                     F.array().cast("array<long>")))).alias("h__"))
    names = [c for c in h.columns if c != "h__"]
    return h.select(*names, _shingles(F.col("h__")).alias(out))


def _permuted(x: Column, band: Column) -> Column:
    return F.xxhash64(x, band)


def template_units(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``unit, template, shingles, window, whole`` of every unit.

    ``whole`` is the template's set of shingles.
    """
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string")
    t = with_shingles(rows, "text", [F.col("template")], "all")
    t = t.withColumn("whole", F.array_distinct("all"))
    starts = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / UNIT).cast("int"))
    t = t.select("template", "whole", "all", F.explode(starts).alias("k"))
    t = t.withColumn("shingles", F.array_distinct(F.slice("all", F.col("k") * UNIT + 1, F.lit(UNIT))))
    n = F.size("shingles")
    window = F.lit(WINDOWS[-1])
    for w in reversed(WINDOWS[:-1]):
        window = F.when(n <= w, F.lit(w)).otherwise(window)
    return t.select(F.xxhash64("template", "k").alias("unit"), "template", "shingles", window.alias("window"), "whole")


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
) -> DataFrame:
    """``id, template, n_found, n_shingles, containment`` of every notice found."""
    spark = docs.sparkSession
    units = template_units(spark, TEMPLATES if templates is None else templates)
    # One line per unit and band: the window length, the minimum, and the shingle that has it.
    keyed = (units.select("unit", "template", "window", "whole", "shingles",
                          F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
             .withColumn("least", F.array_min(F.transform(
                 "shingles", lambda x: F.struct(_permuted(x, F.col("band")).alias("v"), x.alias("x"))))))
    # At most units x bands lines: a literal that every task looks up.
    keys = keyed.select("template", "window", "band", F.col("least.v").alias("key"), F.col("least.x").alias("x")).collect()
    whole = {r["template"]: r["whole"] for r in units.select("template", "whole").distinct().collect()}
    if not keys:
        return docs.where(F.lit(False)).select(
            F.col(id_col), F.lit("").alias("template"), F.lit(0).cast("long").alias("n_found"),
            F.lit(0).cast("long").alias("n_shingles"), F.lit(0.0).alias("containment"))
    of_shingle: dict[int, list[Column]] = {}
    for r in sorted(keys):
        of_shingle.setdefault(r["x"], []).append(F.struct(
            F.lit(r["template"]).alias("template"), F.lit(r["window"]).alias("window"), F.lit(r["band"]).alias("band"),
            F.lit(r["key"]).alias("key")))
    lookup = F.create_map(*[c for x, ks in of_shingle.items() for c in (F.lit(x), F.array(*ks))])
    sets = F.create_map(*[c for t, xs in sorted(whole.items()) for c in (F.lit(t), F.array(*[F.lit(x) for x in xs]))])
    anchors = sorted(of_shingle)

    rows = docs.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text__"))
    g = with_shingles(rows, "text__", [F.col("id__")], "g")
    near = g.where(F.arrays_overlap("g", F.array(*[F.lit(x) for x in anchors])))

    def agrees(at: Column, k: Column) -> Column:
        """Whether a window of the unit's length around place ``at`` has the band's minimum."""
        window, band = k["window"], k["band"]
        # Windows that hold the shingle, at a quarter's stride.
        stride = F.greatest(F.lit(1), (window / 4).cast("int"))
        first = F.ceil(F.greatest(F.lit(0), at - window + 1) / stride).cast("int")
        return F.exists(F.sequence(first, F.floor(at / stride).cast("int")), lambda s: F.array_min(F.transform(
            F.slice("g", s * stride + 1, window), lambda x: _permuted(x, band))) == k["key"])

    # All inside the row: its anchor places, what they retrieve, and how much of that the text holds.
    places = F.filter(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h["x"].isin(anchors))
    retrieved = F.array_distinct(F.flatten(F.transform(places, lambda h: F.transform(
        F.filter(F.element_at(lookup, h["x"]), lambda k: agrees(h["i"], k)), lambda k: k["template"]))))
    held = near.select("id__", "g", F.explode(F.array(retrieved)).alias("templates"))
    found = F.transform("templates", lambda t: F.struct(
        t.alias("template"), F.size(F.array_intersect(F.element_at(sets, t), F.col("g"))).cast("long").alias("n_found"),
        F.size(F.element_at(sets, t)).cast("long").alias("n_shingles")))
    out = held.select(F.col("id__").alias(id_col), F.inline(found))
    return (out.where(100 * F.col("n_found") >= round(100 * similarity) * F.col("n_shingles"))
            .withColumn("containment", F.col("n_found") / F.col("n_shingles")))
