"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Windows of a template's length class overlap by half. A window and a template meet if one band of their MinHash values is
equal. A window that holds a whole template has similarity 1/6 to it at least, and with 64 bands of one value it collides
with probability 1 - (5/6)^64 > 0.99999. A hit is kept if at least ``share`` of the template's shingles occur in the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.common import broadcast_if_small

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_SPDX = ("Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "BUSL-1.1", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
# Notices of common licenses, as they stand in files; whole texts and clauses of the short ones.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    *[("mit", text) for text in (*_MIT[1:], " ".join(_MIT))],
    *[("bsd", text) for text in (*_BSD[1:], " ".join(_BSD[:3] + _BSD[4:]), " ".join(_BSD))],
    *[("isc", text) for text in (*_ISC, " ".join(_ISC))],
    *[(name.lower(), f"SPDX-License-Identifier: {name}") for name in _SPDX],
)
SHINGLE, BANDS = 3, 64


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingle_hashes(words: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(SHINGLE)]))


def _bands(hashes: str) -> Column:
    """One MinHash value per band, with the band's number mixed in."""
    def band(number: int) -> Column:
        return F.xxhash64(F.lit(number), F.array_min(F.transform(hashes, lambda h: F.xxhash64(F.lit(number), h))))

    return F.array(*[band(b) for b in range(BANDS)])


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``license, template, width, grams``; a template needs three words at least.

    ``width``, the length class, is the smallest power of two from 4 on that holds the template."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = rows.select("template", "license", words_of("text").alias("words")).filter(F.size("words") >= SHINGLE)
    width = F.expr("greatest(4, shiftleft(1, length(bin(size(words) - 1))))")
    return rows.select("template", "license", width.alias("width"), F.array_distinct(_shingle_hashes("words")).alias("grams"))


def _windows_of(hit: Column, width: int) -> Column:
    """The two windows of a width class that hold the shingle at place ``hit``."""
    return F.array(*[F.struct(F.lit(width).alias("width"), ((F.floor(hit / width) - back) * width).cast("int").alias("start")) for back in (0, 1)])


def _starts(width: int, wanted: list[int]) -> Column:
    """Windows of a width class around every shingle that one of its templates has."""
    hits = F.filter(F.sequence(F.lit(0), F.size("_grams") - 1), lambda i: F.get(F.col("_grams"), i).isin(wanted))
    return F.array_distinct(F.flatten(F.transform(hits, lambda hit: _windows_of(hit, width))))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, share: float = 0.9) -> DataFrame:
    """``doc_id, license, template, containment, word``: templates found in whole texts, the best window of each.

    ``word`` is the number of the window's first word. Windows of ``2 * width`` words start every ``width`` words, so each
    passage of ``width`` words lies whole in one of them. A window that shares no shingle with any template of its class
    has similarity 0 and is passed over. Null and empty texts and texts of one or two words give no row; repeated rows give one row per id and
    template; an empty table gives none. Other columns are not read. ``templates`` is a list, so its size is bounded.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    listed = known.select("width", F.explode("grams").alias("gram")).distinct().collect()  # of the given list only
    wanted: dict[int, list[int]] = {}
    for row in listed:
        wanted.setdefault(row.width, []).append(row.gram)
    rows = docs.select("doc_id", words_of("text").alias("_words"))
    rows = rows.withColumn("_grams", F.when(F.size("_words") >= SHINGLE, _shingle_hashes("_words")))
    starts = F.when(F.size("_grams") > 0, F.flatten(F.array(*[_starts(width, grams) for width, grams in sorted(wanted.items())])))
    # outer, so that no condition on the windows is moved below their computation and makes it run twice
    windows = rows.withColumn("_starts", starts).select("doc_id", "_grams", F.explode_outer("_starts").alias("_w")).filter("_w.start >= 0").select(
        "doc_id", "_w.width", F.col("_w.start").alias("word"),
        F.array_distinct(F.slice("_grams", F.col("_w.start") + 1, F.col("_w.width") * 2 - SHINGLE + 1)).alias("_window"))
    banded = windows.withColumn("_all", F.array_distinct(_bands("_window"))).select("doc_id", "width", "word", "_window", F.explode_outer("_all").alias("_band"))
    bands = known.select("template", "width", F.explode(F.array_distinct(_bands("grams"))).alias("_band"))
    pairs = banded.join(F.broadcast(bands), ["width", "_band"]).join(F.broadcast(known.drop("width")), "template")  # as long as the list
    inside = F.size(F.array_intersect("_window", "grams")) / F.size("grams")
    found = pairs.select("doc_id", "license", "template", inside.alias("containment"), "word").filter(F.col("containment") >= share)
    best = F.max(F.struct("containment", (-F.col("word")).alias("word")))
    return found.groupBy("doc_id", "license", "template").agg(best.alias("_b")).select(
        "doc_id", "license", "template", F.col("_b.containment").alias("containment"), (-F.col("_b.word")).alias("word"))
