"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_sieve, sieve, stored, table

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: A window is four neighbouring shingles, eight words; windows of a text start at every second shingle, a template's at each.
WINDOW_SHINGLES = 4
WINDOW_STEP = 2
#: MinHash rows of a window, in bands of two. A band collides with the square of the windows' Jaccard, so one of eight bands does with
#: 1 - (1 - J^2)^8. What a text holds of a template of six shingles or more at containment 0.8 has a stretch of five shingles
#: unbroken (a changed word breaks five of them, an added one four), hence a whole window in common: J = 1, collision certain.
#: Four or five shingles: two windows of J >= 3/5, 0.9992. Three: J >= 3/4, 0.9986. Templates of one or two shingles are indexed
#: by single rows (LOOSE_SHINGLES), of which one collides with 1 - (1 - J)^16 in each of two windows: 0.9999 at J = 1/4.
ROWS = 16
BAND_ROWS = 2
LOOSE_SHINGLES = 2
#: Bits of the sieve for each value of the index: a window is looked up 26 times, and few should pass by chance.
SIEVE_BITS = 1024
#: The index of the templates is broadcast up to this many rows of 28 bytes; beyond, it is joined by a shuffle of the few rows that pass the sieves.
MOST_BROADCAST = 1_000_000
#: License notices and short licenses as their publishers word them, and lines in common use that name a license.
TEMPLATES = (
    ("agpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("lgpl-2.1-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
)


def license_words(text: Column) -> Column:
    """Lower-case words: runs of letters and digits, everything beyond ASCII being a letter."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", -1), "")


def _hold(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with a column that is computed once a row: a generator keeps the optimizer from copying it into its uses."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _shingles(words: str) -> Column:
    n = F.size(words) - SHINGLE_WORDS
    return F.when(n >= 0, F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.xxhash64(F.slice(words, i, SHINGLE_WORDS)))).otherwise(F.array().cast("array<bigint>"))


def _windows(shingles: str, step: int) -> Column:
    """Structs of WINDOW_SHINGLES neighbours; a window over the end holds its first shingle in place of what is missing."""
    at = lambda i, k: F.coalesce(F.get(shingles, i + k), F.get(shingles, i), F.lit(0).cast("long")).alias(f"s{k}")
    return F.transform(F.sequence(F.lit(0), F.size(shingles) - 1, F.lit(step)), lambda i: F.struct(*(at(i, k) for k in range(WINDOW_SHINGLES))))


def _min_rows() -> list[Column]:
    """The MinHash rows of a window s0..: for each of ROWS hash functions the least value."""
    mark = [(k + 1) * 0x1F3D5B79A2C4E687 % (1 << 63) for k in range(ROWS)]
    return [F.least(*(F.xxhash64(F.col(f"s{j}").bitwiseXOR(F.lit(mark[k]))) for j in range(WINDOW_SHINGLES))).alias(f"m{k}") for k in range(ROWS)]


def _bands() -> list[Column]:
    """A value for each band of the rows m0..; values of different bands differ, as the rows' hash functions do."""
    turned = lambda c: F.shiftleft(c, 23).bitwiseOR(F.shiftrightunsigned(c, 41))
    return [F.col(f"m{k}").bitwiseXOR(turned(F.col(f"m{k + 1}"))).alias(f"b{k // BAND_ROWS}") for k in range(0, ROWS, BAND_ROWS)]


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """license, text of pairs in the code; a larger set can come from any table with these columns."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates))))


def template_index(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(license, n: the number of distinct shingles; kind, value, license: what retrieves and what verifies a template).

    kind 0: bands and single rows of the templates' windows; kind 1: their shingles.
    """
    rows = _hold(_hold(templates.select("license", "text"), license_words(F.col("text")), "w"), _shingles("w"), "sh").where(F.size("sh") > 0).select("license", "sh")
    rows = stored(rows, "license-shingles")
    sizes = rows.select("license", F.explode("sh").alias("s")).groupBy("license").agg(F.count_distinct("s").alias("n"))
    windows = rows.select("license", F.size("sh").alias("size"), F.posexplode(_windows("sh", 1)).alias("at", "w")).where((F.col("at") == 0) | (F.col("at") + WINDOW_SHINGLES <= F.col("size"))).select("license", "size", "w.*")
    signed = windows.select("license", "size", *_min_rows())
    loose = F.array(*(F.col(f"m{k}") for k in range(ROWS)))
    bands = signed.select("license", F.explode(F.when(F.col("size") <= LOOSE_SHINGLES, loose).otherwise(F.array(*_bands()))).alias("value"))
    shingles = rows.select("license", F.explode("sh").alias("value"))
    index = bands.select(F.lit(0).alias("kind"), "value", "license").unionByName(shingles.select(F.lit(1).alias("kind"), "value", "license")).distinct()
    return stored(sizes, "licenses"), stored(index, "license-index")


def license_scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """id, license, containment of each license that a text holds.

    A template is retrieved for a text where a band of one of the text's windows is one of the template's. containment
    is the share of a retrieved template's distinct shingles that occur in the text; rows under `least` are left out.
    Windows that pass a sieve of the index's bands, and shingles that pass one of its shingles, meet the index in an
    equi-join; all others end where the text is read, so what is shuffled is a row for each text and template that
    share something, and a text's work grows with its length. Edge cases: null texts, and texts or templates of fewer than
    five words, match nothing; rows are told apart by a number of their own, so repeated rows and null ids each have
    their rows; templates that a text holds alike all have a row; other columns of docs play no part; an empty table of
    texts or templates gives none.
    """
    sizes, index = template_index(template_table(docs.sparkSession) if templates is None else templates)
    bits, words = sieve(index, F.col("value"), SIEVE_BITS)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), license_words(F.col(text_col)).alias("_raw"))
    rows = _hold(rows, F.col("_raw"), "_w").where(F.size("_w") >= SHINGLE_WORDS).select("_row", "_id", "_w")
    rows = _hold(rows, _shingles("_w"), "_sh").select("_row", "_id", F.explode(_windows("_sh", WINDOW_STEP)).alias("_s")).select("_row", "_id", "_s.*")
    signed = rows.select("_row", "_id", "s0", "s1", *_min_rows())
    passes = lambda c: in_sieve(bits, words, c)
    values = [*_bands(), *(F.col(f"m{k}") for k in range(ROWS)), F.col("s0"), F.col("s1")]
    met = signed.select("_row", "_id", F.posexplode(F.array(*values)).alias("_at", "value")).where(passes(F.col("value")))
    met = met.select("_row", "_id", F.when(F.col("_at") < len(values) - WINDOW_STEP, 0).otherwise(1).alias("kind"), "value")
    met = met.join(F.broadcast(index) if index.count() <= MOST_BROADCAST else index, ["kind", "value"])
    found = met.groupBy("_row", "_id", "license").agg(F.max(F.col("kind") == 0).alias("retrieved"), F.size(F.collect_set(F.when(F.col("kind") == 1, F.col("value")))).alias("held"))
    contained = found.where("retrieved").join(sizes, "license").select(F.col("_id").alias(id_col), "license", (F.col("held") / F.col("n")).alias("containment"))
    return contained.where(F.col("containment") >= least)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license", F.round("containment", 6).alias("containment"))


def _sql() -> str:
    given = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)
    words = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '')"
    shingle = "list_transform(range(1, greatest(1, len(ws) - 3)), lambda i: array_to_string(ws[i:i + 4], ' '))"
    return f"""
WITH t AS (SELECT name, {shingle} AS sh FROM (SELECT name, {words.format('body')} AS ws FROM (VALUES {given}) v(name, body))),
ts AS (SELECT DISTINCT name, unnest(sh) AS s FROM t),
n AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
d AS (SELECT own, doc_id, {shingle} AS sh FROM (SELECT row_number() OVER () AS own, doc_id, {words.format('text')} AS ws FROM documents)),
ds AS (SELECT DISTINCT own, doc_id, unnest(sh) AS s FROM d),
h AS (SELECT own, doc_id, name, count(*) AS held FROM ds JOIN ts USING (s) GROUP BY ALL)
SELECT doc_id, name AS license, round(held / n, 6) AS containment FROM h JOIN n USING (name) WHERE held / n >= {CONTAINMENT}
"""


OP1_SQL = _sql()
