"""License scans: MinHash bands over overlapping text windows find templates, shingles verify them.

Built-in DataFrame functions only. Texts and templates are lower-cased words (letters and digits); shingles are
``SHINGLE_WORDS`` words, and a template with fewer words is one shingle of all of them.

* Templates are put in size classes. A class of up to ``c`` shingles looks at windows of ``2c`` shingles, one
  every ``c``, so a passage of up to ``c`` shingles lies in one window (``SLACK``: insertions make a passage up to
  1.25 times as long as its template).
* Texts, and then windows, without any shingle of a template cannot hold one. The texts that have one are
  written to the shared folder once, so all size classes read their shingles from there.
* ``BANDS`` bands of one MinHash row each. A window that holds ``MIN_CONTAINMENT`` of a template that takes
  at least a fifth of it has Jaccard similarity ``s >= 0.15``, and shares a band with it with probability ``1 - (1 - s)^BANDS``, over
  0.9995 for 48 bands. (Classes double, so a template has more than ``c / 2.5`` shingles.)
* What shares a band is verified by exact shingle containment.

Templates are broadcast: a list of notices, of at most ``MAX_TEMPLATE_WORDS`` words in all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

SHINGLE_WORDS, MIN_CONTAINMENT, BANDS, SLACK = 5, 0.8, 48, 1.25
MAX_TEMPLATE_WORDS = 200_000

#: Widely used license notices (fixed values).
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
}


def load_templates(spark, path: str) -> dict[str, str]:
    """Templates from a folder of text files, one whole license text each, named by file: for ``scan(templates=...)``."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "value")
    return {row["name"]: row["value"] for row in files.collect()}


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingle_hashes(words: Column, size: int) -> Column:
    """One 64-bit hash per run of ``size`` words; none for fewer words."""
    n = F.size(words) - size
    at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))


def _min_hashes(shingles: Column) -> Column:
    def smallest(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(band))))

    return F.array(*map(smallest, range(BANDS)))


def _literal_rows(spark, rows: list[dict]) -> DataFrame:
    """A small table as literals of the plan, so no Python worker makes it."""
    structs = [F.struct(*((F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in row.items())) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _template_rows(spark, templates: dict[str, str]) -> list[dict]:
    """Name, shingle size, distinct shingles and MinHashes of each template with a word."""
    if sum(len(t.split()) for t in templates.values()) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} words in all")
    if not templates:
        return []
    named = _literal_rows(spark, [{"name": name, "body": body} for name, body in templates.items()]).withColumn("words", normal_words("body"))
    rows: list[dict] = []
    for size in range(1, SHINGLE_WORDS + 1):
        fits = (F.size("words") == size) if size < SHINGLE_WORDS else (F.size("words") >= size)
        part = named.where(fits).select("name", F.array_distinct(shingle_hashes(F.col("words"), size)).alias("shingles"))
        rows += [{"name": r["name"], "size": size, "shingles": r["shingles"], "mins": r["mins"]} for r in part.withColumn("mins", _min_hashes(F.col("shingles"))).collect()]
    return rows


def _class_of(row: dict) -> int:
    c = 2
    while c < SLACK * len(row["shingles"]):
        c *= 2
    return c


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` and template it holds: ``doc_id``, ``template``, ``containment``, ``start_word``.

    ``containment`` is the largest share of the template's distinct shingles in a window, ``start_word`` the
    first word of the earliest such window's first shingle of the template. Null and empty texts match nothing. Rows that repeat
    an id each give their rows; null ids are kept. Empty tables, or no templates, give an empty result.
    """
    spark = docs.sparkSession
    rows = _template_rows(spark, TEMPLATES if templates is None else templates)
    if not rows:
        return spark.createDataFrame([], "doc_id long, template string, containment double, start_word long")
    sizes = sorted({r["size"] for r in rows})

    def wanted(chosen: list[dict]) -> Column:
        return F.array(*(F.lit(h) for h in sorted({h for r in chosen for h in r["shingles"]})))

    base = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    words = base.where("text is not null").select("doc_id", normal_words(F.col("text")).alias("words"))
    # the row number is not deterministic to the optimizer, which so keeps the filter above the hashes
    hashed = words.select("doc_id", F.monotonically_increasing_id().alias("row"), *(shingle_hashes(F.col("words"), k).alias(f"s{k}") for k in sizes))
    some = reduce(Column.__or__, (F.arrays_overlap(f"s{k}", wanted([r for r in rows if r["size"] == k])) for k in sizes))
    candidates = materialize(hashed.where((F.col("row") >= 0) & some), "license_candidates")
    found: list[DataFrame] = []
    for size, c in sorted({(r["size"], _class_of(r)) for r in rows}):
        mine = [r for r in rows if (r["size"], _class_of(r)) == (size, c)]
        texts = candidates.select("doc_id", "row", F.col(f"s{size}").alias("shingles")).where(F.arrays_overlap("shingles", wanted(mine)))
        starts = F.sequence(F.lit(0), F.size("shingles") - 1, F.lit(c))
        windows = texts.select("doc_id", "row", F.explode(F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice(F.col("shingles"), s + 1, F.lit(2 * c)).alias("window")))).alias("w"))
        windows = windows.select("doc_id", "row", "w.at", "w.window").where(F.arrays_overlap("window", wanted(mine)))
        keyed = windows.select("doc_id", "row", "at", "window", F.posexplode(_min_hashes(F.col("window"))).alias("band", "key"))
        known = _literal_rows(spark, [{"template": r["name"], "known": r["shingles"], "mins": r["mins"]} for r in mine])
        bands = known.select("template", "known", F.posexplode("mins").alias("band", "key"))
        hits = keyed.join(F.broadcast(bands), ["band", "key"]).select("doc_id", "row", "at", "window", "template", "known")
        share = F.size(F.array_intersect("window", "known")) / F.size("known")
        first = F.array_min(F.transform("known", lambda h: F.nullif(F.array_position(F.col("window"), h), F.lit(0))))
        checked = hits.select("doc_id", "row", "template", share.alias("containment"), (F.col("at") + first - 1).alias("start_word"))
        found.append(checked.where(F.col("containment") >= MIN_CONTAINMENT))
    best = reduce(DataFrame.unionByName, found).groupBy("row", "doc_id", "template").agg(F.max(F.struct("containment", (-F.col("start_word")).alias("back"))).alias("best"))
    return best.select("doc_id", "template", F.col("best.containment").alias("containment"), (-F.col("best.back")).cast("bigint").alias("start_word"))

