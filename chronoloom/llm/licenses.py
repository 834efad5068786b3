"""License scans with DataFrame functions alone: Dice coefficient of word bigrams against licence templates.

A segment (a line, or a paragraph of several lines) is compared as a whole, and so are passages in it of a template's number of
words, so that a notice within a longer line is found. A text of n distinct bigrams can reach the coefficient d with a
template of m only if n is from m * d / (2 - d) to m * (2 - d) / d, and only if it shares at least m * d / (2 - d) bigrams with
it: so one at least of any m + 1 minus that many. Segments without one of these few are passed over at once; sizes and
shared bigrams prune the templates for the rest.
"""

from __future__ import annotations

import json
import math
import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, pick, read

LEAST_DICE = 0.8
#: Licence notices and paragraphs. Fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-notice": "Released under the BSD License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-body": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
    "public-domain": "This work is in the public domain.",
    "apache-2.0-terms": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def normalised(text: str) -> list[str]:
    """Words: lower-cased, runs of other characters than a-z and 0-9 are what parts them."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> set[str]:
    """The distinct word bigrams of a normalised text."""
    words = normalised(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _hash(gram: str) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _bigrams(text: Column) -> Column:
    """Hashes of the bigrams of a text, repeats included."""
    w = F.split(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    return let(w, lambda v: F.transform(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.concat(x, F.lit(" "), F.get(v, i + 1)))))


def bounds(m: int, dice: float) -> tuple[int, int]:
    """The least and greatest number of bigrams that can reach ``dice`` with a template of m."""
    return math.ceil(m * dice / (2 - dice) - 1e-9), math.floor(m * (2 - dice) / dice + 1e-9)


def telling(templates: dict[str, set[str]], dice: float) -> set[str]:
    """Bigrams of which every text that reaches ``dice`` with some template has one: of each, those in fewest templates."""
    shared = lambda g: sum(g in t for t in templates.values())
    common = {"of the", "in the", "to the", "is in", "and the", "the following", "the extent", "this work", "may not", "you may", "in source", "at your", "copy of", "of this", "to any", "any person", "you can", "it and", "and or", "or any", "to this", "use in"}
    return {g for t in templates.values() for g in sorted(t, key=lambda g: (g in common, shared(g), g))[: len(t) - bounds(len(t), dice)[0] + 1]}


def _best(h: Column, t: Column) -> Column:
    """The best coefficient of a segment's bigrams h (in their order) with a template t; null if none can be enough."""
    dice = lambda d: 2 * F.size(F.array_intersect(d, t["own"])) / (F.size(d) + t["m"])
    begins = lambda i: (i == F.size(h) - t["n"]) | F.array_contains(t["own"], F.get(h, i))
    starts = F.filter(F.sequence(F.lit(0), F.size(h) - t["n"]), begins)
    within = F.when(F.size(h) > t["n"], F.array_max(F.transform(starts, lambda i: let(F.array_distinct(F.slice(h, i + 1, t["n"])), dice))))
    whole = lambda b: F.when(F.size(b).between(t["lo"], t["hi"]), dice(b))
    return let(F.array_distinct(h), lambda b: F.when(F.size(F.array_intersect(b, t["own"])) >= t["lo"], F.greatest(whole(b), within)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, dice: float = LEAST_DICE) -> DataFrame:
    """(doc_id, license_id, dice, n_segments): for each row and licence found, the best coefficient and the number of segments.

    Segments are lines, and paragraphs of several lines beside these. In longer segments, passages of a template's number of
    words count that begin with one of its bigrams or end the segment. Segments with the same text count each. Null and empty texts, and
    segments of one word, have no licence; rows without a doc_id are reported with none; repeated rows are reported as one.
    Extra columns are ignored.
    """
    grams = {k: g for k, v in templates.items() if (g := bigrams(v))}
    found = pick(docs, "doc_id", "text")
    if not grams:
        return found.limit(0).select("doc_id", F.lit("").alias("license_id"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_segments"))
    marks = sorted(_hash(g) for g in telling(grams, dice))
    marked = lambda h: F.exists(h, lambda x: x.isin(marks))
    found = found.where(marked(_bigrams(F.col("text"))))
    paragraphs = F.filter(F.split("text", r"\n[\x20\x09-\x0D]*\n", -1), lambda p: F.contains(p, F.lit("\n")))
    segments = found.select("doc_id", F.explode(F.concat(F.split("text", "\n", -1), paragraphs)).alias("s"))
    segments = segments.select("doc_id", _bigrams(F.col("s")).alias("h")).where(marked(F.col("h")))
    rows = [{"license_id": k, "own": sorted(map(_hash, g)), "m": len(g), "n": len(normalised(templates[k])) - 1, "lo": bounds(len(g), dice)[0], "hi": bounds(len(g), dice)[1]} for k, g in grams.items()]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<license_id:string,own:array<bigint>,m:int,n:int,lo:int,hi:int>>")
    tried = F.transform(table, lambda t: F.struct(t["license_id"].alias("license_id"), _best(F.col("h"), t).alias("dice")))
    hits = segments.select("doc_id", F.explode(F.filter(tried, lambda x: x["dice"] >= dice)).alias("x"))
    return hits.groupBy("doc_id", "x.license_id").agg(F.max("x.dice").alias("dice"), F.count("*").alias("n_segments"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence of every document."""
    out = scan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "license_id", F.round("dice", 6).alias("dice"), "n_segments")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in TEMPLATES.items())
    norm = lambda c: f"string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t AS (SELECT license_id, list_distinct({grams}) AS g, len(w) - 1 AS n FROM (SELECT license_id, {norm('body')} AS w FROM (VALUES {rows}) v(license_id, body))),
l AS (SELECT *, ceil(len(g) * {LEAST_DICE} / (2 - {LEAST_DICE}) - 1e-9) AS lo, floor(len(g) * (2 - {LEAST_DICE}) / {LEAST_DICE} + 1e-9) AS hi FROM t),
s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents
    UNION ALL SELECT doc_id, s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[\\x20\\x09-\\x0D]*\\n')) AS s FROM documents) WHERE contains(s, chr(10))),
h AS (SELECT doc_id, {grams} AS h FROM (SELECT doc_id, {norm('s')} AS w FROM s)),
b AS (SELECT doc_id, h, list_distinct(h) AS b FROM h),
c AS (SELECT doc_id, license_id, h, b, g, n, lo, hi, len(list_intersect(b, g)) AS shared FROM b, l WHERE len(b) >= lo AND len(list_intersect(b, g)) >= lo),
d AS (SELECT doc_id, license_id, greatest(
    CASE WHEN len(b) BETWEEN lo AND hi THEN 2 * shared / (len(b) + len(g)) END,
    CASE WHEN len(h) > n THEN list_max(list_transform(list_filter(range(0, len(h) - n + 1), lambda i: i = len(h) - n OR list_contains(g, h[i + 1])),
        lambda i: 2 * len(list_intersect(list_distinct(h[i + 1 : i + n]), g)) / (len(list_distinct(h[i + 1 : i + n])) + len(g)))) END) AS dice FROM c)
SELECT doc_id, license_id, round(max(dice), 6) AS dice, count(*) AS n_segments FROM d WHERE dice >= {LEAST_DICE} GROUP BY doc_id, license_id
"""


OP3_SQL = _sql()
