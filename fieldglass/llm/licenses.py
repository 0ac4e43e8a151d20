"""Licence scans: Dice coefficient over word bigrams, in DataFrame functions only.

Texts are normalised (lower case, letters and digits, "licence" and "license" alike). A unit of a text is compared to a
template by 2 * shared / (bigrams of the unit + bigrams of the template). Units are the whole text, its paragraphs, its
lines, and every run of as many words as the template has, so a notice is found however it is wrapped and whatever stands
around it. A coefficient of `least` bounds the size of a unit between least / (2 - least) and (2 - least) / least of the
template's, and what it must share: at least least / (2 - least) of the template's bigrams. So one of a few bigrams of
the template (its probes, those of the longest words) is in every match. Texts without a word of any probe go at once,
templates without a probe in the text are not candidates, and runs are only tried around probes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.shared import once

# Licence notices and texts as their stewards word them.
TEMPLATES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "BSD-2-Clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ],
}
#: Dice coefficient from which a unit counts as a template's.
LEAST = 0.9


def normal_words(text: Column, breaks: bool = False) -> Column:
    """Words of letters and digits in lower case; the British spelling is read as the American one. Null has none. With
    breaks, each line break is a word of its own."""
    split = "[^\\p{L}\\p{N}\n]+|(?<=\n)|(?=\n)" if breaks else "[^\\p{L}\\p{N}]+"
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "licence", "license"), split), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    """The pairs of adjacent words, in order and by hash; none of a single word."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def template_table(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """license, template (its number), m (words), t_grams (distinct pairs), t (how many), probes, probe_words.

    The templates are a list in this module: their size is fixed.
    """
    rows = [(name, i, text) for name, texts in sorted(templates.items()) for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "license string, template int, text string").withColumn("words", normal_words(F.col("text")))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct((-F.greatest(F.length(F.get("words", i - 1)), F.length(F.get("words", i)))).alias("rank"), F.xxhash64(F.get("words", i - 1), F.get("words", i)).alias("gram"), F.when(F.length(F.get("words", i - 1)) >= F.length(F.get("words", i)), F.get("words", i - 1)).otherwise(F.get("words", i)).alias("word")))
    table = table.withColumn("ranked", F.array_sort(F.array_distinct(pairs))).withColumn("t", F.size("ranked"))
    # A match shares ceil(share * t) at least, so of any t - ceil(share * t) + 1 bigrams it has one.
    picked = F.slice("ranked", 1, (F.col("t") - F.ceil(F.col("t") * F.lit(least / (2 - least)) - F.lit(1e-9)) + 1).cast("int"))
    table = table.withColumn("picked", picked)
    return table.select("license", "template", F.size("words").alias("m"), F.transform("ranked", lambda x: x["gram"]).alias("t_grams"), "t", F.transform("picked", lambda x: x["gram"]).alias("probes"), F.array_distinct(F.transform("picked", lambda x: x["word"])).alias("probe_words"))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, matches, license.

    matches: array of (license, template, start, words, dice), one for each template of which a unit has the coefficient
    `least`: its best unit, the first and then the shortest of equal ones, by word numbers from 0; best first, ties by
    licence and template. license: that of the best match, null without one. Null, empty and wordless texts have no
    match; repeated rows match alike. Other columns are ignored; no rows give no rows.
    """
    table = template_table(docs.sparkSession, templates, least)
    seen = sorted({w for r in table.select("probe_words").collect() for w in r.probe_words})  # fixed by the templates
    seen += [w.replace("license", "licence") for w in seen if "license" in w]
    ratio = (2 - least) / least
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    # Words of the probes are of a-z and digits, so they stand between other characters however the text is split.
    spoken = F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+"), F.array(*map(F.lit, seen)))
    marked = once(rows.where(spoken).select("doc_id", "text_key", "text"), "tokens", normal_words(F.col("text"), breaks=True)).drop("text")
    breaks = F.filter(F.transform("tokens", lambda w, i: F.when(w == "\n", i)), lambda i: i.isNotNull())
    lined = marked.withColumn("breaks", breaks).withColumn("words", F.filter("tokens", lambda w: w != "\n"))
    lined = once(lined.where(F.size("words") > 1).drop("tokens"), "grams", pairs_of(F.col("words")))
    # Where lines begin, and where the text ends; a place that comes twice is an empty line, so a paragraph begins there.
    places = F.concat(F.array(F.lit(0)), F.transform("breaks", lambda x, i: x - i), F.array(F.size("words")))
    placed = once(lined, "places", places).withColumn("n", F.size("words")).drop("breaks", "words")
    blank = F.filter("places", lambda x, i: (i > 0) & (x == F.get("places", i - 1)))
    placed = placed.withColumn("starts", F.array_distinct(F.concat(F.array(F.lit(0)), blank, F.array(F.col("n")))))

    def between(at: str) -> Column:
        return F.transform(F.slice(at, 1, F.size(at) - 1), lambda x, i: F.struct(x.alias("start"), (F.get(at, i + 1) - x).alias("words")))

    units = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("words"))), between("starts"), between("places"))
    several = once(placed, "units", F.filter(units, lambda u: u["words"] > 1)).drop("places", "starts")
    met = several.join(F.broadcast(table), F.arrays_overlap("grams", "probes"))
    hits = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains("probes", g), i)), lambda i: i.isNotNull())
    runs = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.sequence(F.greatest(p - F.col("m") + 2, F.lit(0)), F.greatest(F.least(p, F.col("n") - F.col("m")), F.greatest(p - F.col("m") + 2, F.lit(0)))))))
    runs = F.transform(F.filter(runs, lambda s: s + F.col("m") <= F.col("n")), lambda s: F.struct(s.alias("start"), F.col("m").alias("words")))
    # A unit of too few words has too few bigrams; one of too many may repeat itself, so its bigrams are counted.
    fits = F.filter("units", lambda u: (u["words"] - 1) * ratio >= F.col("t"))

    def scored(u: Column) -> Column:
        own = F.array_distinct(F.slice("grams", u["start"] + 1, u["words"] - 1))
        return F.struct((-2 * F.size(F.array_intersect(own, "t_grams")) / (F.size(own) + F.col("t"))).alias("rank"), u["start"].alias("start"), u["words"].alias("words"))

    best = once(met, "best", F.array_min(F.transform(F.concat(runs, fits), scored))).where(F.col("best.rank") <= -least)
    found = best.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("best.rank", "license", "template", "best.start", "best.words"))).alias("found"))
    told = F.transform("found", lambda x: F.struct(x["license"].alias("license"), x["template"].alias("template"), x["start"].alias("start"), x["words"].alias("words"), (-x["rank"]).alias("dice")))
    matched = found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), told.alias("matches"))
    none = F.array().cast("array<struct<license:string,template:int,start:int,words:int,dice:double>>")
    out = rows.select("doc_id", "text_key").join(matched, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    return out.select("doc_id", F.coalesce("matches", none).alias("matches"), F.get("matches", F.lit(0))["license"].alias("license"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    best = F.get("matches", F.lit(0))
    return scan_licenses(docs).select("doc_id", "license", best["start"].alias("start"), best["words"].alias("words"), F.round(best["dice"], 6).alias("dice"), F.size("matches").cast("long").alias("n_matches"))
