"""License notices in texts: MinHash bands over windows find templates, containment verifies them.

Texts and templates are cut into words (lower-case letters and digits) and five-word shingles. A
template of S shingles is looked for in windows of 2w shingles at every w-th place, w the power of
two from S up, so one window always holds it whole. With three quarters of its shingles there, a
window and its template have a Jaccard similarity of at least 0.75 S / (2w + 0.25 S), which is
0.176 at worst (S just above w / 2). Of 64 bands of one MinHash row, all miss with a probability
of (1 - 0.176) ** 64 = 4e-6 then, and of 1e-8 for a notice that is there whole.

A window that holds no shingle of any template cannot agree with a template in any MinHash, so
only windows around such shingles are hashed. All of it is DataFrame functions; the only shuffle
is the one that gathers what overlapping windows found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

K = 5
BANDS = 64
PERCENT = 75

# Names and texts of notices.
TEMPLATES = (
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("MIT-line", "Released under the MIT License."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: runs of a-z, 0-9 and all characters beyond ASCII. Null has none."""
    clean = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ")
    return F.filter(F.split(clean, " "), lambda w: w != "")


def _shingles(tokens: str) -> Column:
    """Hashes of all five-word windows of an array column of words, in order."""
    at = lambda i, j: F.element_at(F.col(tokens), (i + j).cast("int"))
    each = F.transform(F.sequence(F.lit(1), F.size(tokens) - (K - 1)), lambda i: F.xxhash64(*[at(i, F.lit(j)) for j in range(K)]))
    return F.when(F.size(tokens) >= K, each).otherwise(F.array().cast("array<bigint>"))


def _min_hashes(shingles: Column) -> Column:
    """One minimum per band."""
    seeds = F.array(*[F.lit(1000 + b).cast("long") for b in range(BANDS)])
    return F.transform(seeds, lambda s: F.array_min(F.transform(shingles, lambda h: F.xxhash64(s, h))))


def templates(spark: SparkSession, texts=TEMPLATES) -> DataFrame:
    """Name, shingles (distinct), their number and window step of each template of five words or more."""
    rows = ", ".join("('%s', '%s')" % tuple(x.replace("\\", "\\\\").replace("'", "\\'") for x in t) for t in texts)
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(license, text)")
    found = table.withColumn("w", words(F.col("text"))).withColumn("goal", F.array_distinct(_shingles("w"))).where(F.size("goal") > 0)
    step = F.pow(F.lit(2), F.ceil(F.log2(F.size("goal").cast("double")))).cast("int")
    return found.select("license", "goal", F.size("goal").alias("total"), step.alias("step"))


def scan(docs: DataFrame, texts=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and notice: id, ``license``, ``containment``, ``found_shingles``, ``start_word``.

    A notice is in a text if one window holds at least three quarters of its distinct shingles;
    the row tells the best window (ties: the first) and the number of its first word from 0.
    Null, empty and short texts have none; repeated ids count as one document; templates of fewer
    than five words are not looked for; an empty table gives no rows.
    """
    spark = docs.sparkSession
    # One row per template, so what is collected and broadcast is as long as the list above.
    known = templates(spark, texts)
    every = known.agg(F.array_distinct(F.flatten(F.collect_list("goal"))).alias("h"), F.sort_array(F.collect_set("step")).alias("s")).first()
    wanted = F.lit(every.h)
    steps = F.lit(every.s)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # The row number keeps the optimizer from moving the filter below the shingles, where it
    # would compute words and shingles anew at every use; the table is written for that too.
    hashed = source.withColumn("w", words(F.col("text"))).select("id", _shingles("w").alias("sh"), F.monotonically_increasing_id().alias("row"))
    holding = cut_lineage(hashed.where(F.arrays_overlap("sh", wanted)))
    places = F.filter(F.sequence(F.lit(0), F.size("sh") - 1), lambda i: F.array_contains(wanted, F.element_at("sh", (i + 1).cast("int"))))
    window = lambda step, k: F.struct(step.alias("step"), (k * step).cast("int").alias("at"))
    around = lambda step: F.flatten(F.transform(F.col("places"), lambda p: F.array(window(step, F.floor(p / step)), window(step, F.greatest(F.floor(p / step) - 1, F.lit(0))))))
    windows = holding.withColumn("places", places).withColumn("win", F.explode(F.array_distinct(F.flatten(F.transform(steps, around)))))
    windows = windows.select("id", F.col("win.step").alias("step"), F.col("win.at").alias("at"), F.slice("sh", F.col("win.at") + 1, F.col("win.step") * 2).alias("part"))

    banded = lambda df, shingles: df.withColumn("bands", _min_hashes(F.col(shingles)))
    goals = banded(known, "goal")
    # A window meets each template of its step once, if any band agrees: no row per band.
    agree = F.exists(F.zip_with("bands", "their_bands", lambda x, y: x == y), lambda same: same)
    met = banded(windows, "part").join(F.broadcast(goals.withColumnRenamed("bands", "their_bands")), "step").where(agree)
    common = F.array_intersect("part", "goal")
    first = F.array_position(F.transform("part", lambda h: F.array_contains(F.col("goal"), h)), F.lit(True))
    checked = met.withColumn("found", F.size(common)).where(F.col("found") * 100 >= F.col("total") * PERCENT)
    best = checked.groupBy("id", "license").agg(
        F.max_by(F.struct("found", "total", (F.col("at") + first - 1).alias("start")), F.struct("found", -(F.col("at") + first))).alias("b")
    )
    out = best.select("id", "license", (F.col("b.found") / F.col("b.total")).alias("containment"), F.col("b.found").cast("long").alias("found_shingles"), F.col("b.start").cast("long").alias("start_word"))
    return out.withColumnRenamed("id", id_col)


def oracle() -> str:
    """The same rows in DuckDB's SQL, by counting all shared shingles of all windows."""
    quoted = ", ".join("('%s', '%s')" % tuple(x.replace("'", "''") for x in t) for t in TEMPLATES)
    clean = lambda c: f"list_filter(string_split(regexp_replace(translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' '), lambda w: w <> '')"
    rolled = f"list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' '))"
    return f"""
    WITH t AS (SELECT license, list_distinct({rolled}) AS goal FROM (SELECT license, {clean("text")} AS w FROM (VALUES {quoted}) v(license, text)) WHERE len(w) >= {K}),
    g AS (SELECT license, len(goal) AS total, CAST(pow(2, ceil(log2(len(goal)))) AS BIGINT) AS step, unnest(goal) AS h FROM t),
    d AS (SELECT doc_id, {rolled} AS sh FROM (SELECT doc_id, {clean("text")} AS w FROM documents) WHERE len(w) >= {K}),
    p AS (SELECT doc_id, unnest(sh) AS h, generate_subscripts(sh, 1) - 1 AS place FROM d),
    hit AS (SELECT doc_id, license, total, step, place, h FROM p JOIN g USING (h)),
    win AS (SELECT DISTINCT *, place // step * step AS spot FROM hit UNION SELECT DISTINCT *, greatest(place // step - 1, 0) * step FROM hit),
    n AS (SELECT doc_id, license, total, spot, count(DISTINCT h) AS found, min(place) AS start FROM win GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY found DESC, start) AS k FROM n WHERE found * 100 >= total * {PERCENT})
    SELECT doc_id, license, found / total AS containment, CAST(found AS BIGINT) AS found_shingles, CAST(start AS BIGINT) AS start_word FROM r WHERE k = 1
    """
