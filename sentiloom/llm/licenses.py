"""License texts in documents: MinHash bands over windows, then containment.

For a template of m shingles the document's windows are 2 m shingles long and
start every m, so some window holds any copy whole.  Windows and templates
meet in bands of one MinHash value; the number of bands makes a meeting all
but certain, and exact containment of the template's shingles decides.
All of it is column expressions and joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentiloom.llm.common import packed, store

SHINGLE = 5
CONTAINED = 0.8
#: A template that is contained is missed with at most this probability.
MISSED = 1e-4
#: Templates are compared in memory: at most so many shingles of them in all.
MOST_SHINGLES = 1 << 18

# Wording of public licenses, as their texts and notices have it.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met: Redistributions of source code must retain the above copyright"
        " notice, this list of conditions and the following disclaimer. Redistributions in binary form must"
        " reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation, either version 3 of the License,"
        " or (at your option) any later version. This program is distributed in the hope that it will be useful,"
        " but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
        " PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the"
        " MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
}


def bands_for(contained: float = CONTAINED, missed: float = MISSED) -> int:
    """Bands of one value that meet with a probability of at least ``1 - missed``.

    A window of 2 m shingles that holds ``contained * m`` of a template's m
    has a Jaccard similarity of at least ``contained / (3 - contained)``.
    """
    similar = contained / (3 - contained)
    return math.ceil(math.log(missed) / math.log(1 - similar))


def shingled(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """``keep`` and ``shingles``: a hash for each run of five words (a-z, 0-9, lower case).

    Words are a column of their own, so that no run extracts them again.
    """
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.xxhash64(w))
    last = F.greatest(F.size("words") - SHINGLE + 1, F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("words", i, SHINGLE)))
    none = F.array().cast("array<bigint>")
    worded = df.select(*[c.alias(f"c{i}") for i, c in enumerate(keep)], words.alias("words"))
    return worded.select(
        *[F.col(f"c{i}") for i in range(len(keep))],
        F.monotonically_increasing_id().alias("place"),
        F.when(F.size("words") >= SHINGLE, runs).otherwise(none).alias("shingles"),
    )


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``(template, m, shingle)`` with distinct shingles; ``m`` is their number."""
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in sorted(templates.items())])
    known = shingled(spark.range(1).select(F.inline(rows)), F.col("text"), F.col("template"))
    every = known.select(F.col("c0").alias("template"), F.array_distinct("shingles").alias("every"))
    return every.select("template", F.size("every").alias("m"), F.explode("every").alias("shingle"))


def _bands(shingle: str, bands: int) -> list[Column]:
    """The smallest hash of a group's shingles, for each band another hash."""
    return [F.min(F.xxhash64(shingle, F.lit(i))).alias(f"b{i}") for i in range(bands)]


def _by_band(df: DataFrame, bands: int, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(F.array(*[f"b{i}" for i in range(bands)])).alias("band", "value"))


def scan(
    df: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    key: str = "doc_id",
    text: str = "text",
    contained: float = CONTAINED,
    missed: float = MISSED,
) -> DataFrame:
    """``(key, template, containment, start_word, end_word)`` for each license found.

    A template counts as found if a window holds ``contained`` of its distinct
    shingles; of several windows the one that holds most is returned, the first
    of those alike.  Words are counted from 0, the end is exclusive.  Null and
    empty texts and those of fewer than five words hold nothing; repeated rows
    are scanned alike and each counts; templates need five words.  Only windows
    that hold the smallest shingle of some band of a template can meet it in
    that band, so MinHashes are computed for these alone; all texts are read
    whole.  Templates are a bounded table and are refused beyond
    ``MOST_SHINGLES``.
    """
    spark = df.sparkSession
    short = [k for k, v in templates.items() if len(v.split()) < SHINGLE]
    total = sum(len(v.split()) for v in templates.values())
    if short or total > MOST_SHINGLES:
        raise ValueError(f"templates without {SHINGLE} words: {short}; {total} words in all, {MOST_SHINGLES} are possible")
    bands = bands_for(contained, missed)
    known = store(template_table(spark, templates), "templates")
    signed = store(known.groupBy("template", "m").agg(*_bands("shingle", bands)), "signatures")
    signature = _by_band(signed, bands, "template", "m")
    # the shingle behind each smallest hash
    marks = store(
        known.select("template", "m", "shingle", F.posexplode(F.array(*[F.xxhash64("shingle", F.lit(i)) for i in range(bands)])).alias("band", "value"))
        .join(F.broadcast(signature), ["template", "m", "band", "value"])
        .select("m", "shingle")
        .distinct(),
        "marks",
    )
    wanted = [r[0] for r in marks.select("shingle").distinct().collect()]
    rows = shingled(packed(df), F.col("row").getField(text), F.col("row").getField(key)).withColumnRenamed("c0", "key")
    some = F.arrays_overlap("shingles", F.array(*[F.lit(x) for x in wanted]).cast("array<bigint>"))
    met = store(rows.where(some), "shingles")
    hits = met.select("place", F.posexplode("shingles").alias("pos", "shingle")).join(F.broadcast(marks), "shingle")
    block = F.floor(F.col("pos") / F.col("m"))
    windows = hits.select("place", "m", F.explode(F.array(block, block - 1)).alias("block")).where("block >= 0").distinct()
    inside = F.slice("shingles", (F.col("block") * F.col("m") + 1).cast("int"), (2 * F.col("m")).cast("int"))
    at = ["place", "m", "block"]
    spread = store(
        windows.join(met.drop("key"), "place").select(*at, F.posexplode(inside).alias("pos", "shingle")), "windows"
    )
    hashed = _by_band(spread.groupBy(*at).agg(*_bands("shingle", bands)), bands, *at)
    pairs = hashed.join(F.broadcast(signature), ["m", "band", "value"]).select(*at, "template").distinct()
    word = F.col("block") * F.col("m") + F.col("pos")
    held = (
        spread.join(F.broadcast(known), ["m", "shingle"])
        .groupBy(*at, "template")
        .agg(F.countDistinct("shingle").alias("n"), F.min(word).alias("start_word"), (F.max(word) + SHINGLE).alias("end_word"))
        .where(F.col("n") >= contained * F.col("m"))
        .join(pairs, [*at, "template"])
    )
    best = held.groupBy("place", "template").agg(
        F.max(F.struct((F.col("n") / F.col("m")).alias("containment"), (-F.col("block")).alias("block"), "start_word", "end_word")).alias("best")
    )
    return met.select("place", F.col("key").alias(key)).join(best, "place").select(
        key, "template", "best.containment", "best.start_word", "best.end_word"
    )
