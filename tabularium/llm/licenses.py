"""Licence scans: lines, paragraphs and whole texts against templates. DataFrame operations only."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.decontaminate import words_of

THRESHOLD = 0.8

#: Public notices and short licence texts.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def template_bigrams(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """``(licence, sorted distinct word bigrams)`` of each template of two words or more."""
    out = []
    for name, texts in templates.items():
        for text in texts:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
            if len(words) > 1:
                out.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})))
    return out


def license_matches(
    docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, license, n_lines, n_paragraphs, whole_text, best_dice)``, a row per document and licence that it holds.

    Every line, every paragraph (lines up to a blank one) and the whole text is normalised to words (A-Z lower-cased,
    ASCII punctuation and space dropped) and compared with every template by the Dice coefficient of the sets of word
    bigrams. Sizes prune first: a coefficient of ``t`` needs sets whose sizes differ by a factor of (2-t)/t at most, so
    a unit is compared with the templates inside that range only, and not at all if it shares no bigram with any. The
    templates are a short list of literals; no text is shuffled, only matches are grouped.

    Null, empty and one-word texts match nothing; rows with the same id (null included) are counted together.
    """
    known = template_bigrams(TEMPLATES if templates is None else templates)
    sizes = [len(b) for _, b in known] or [1]
    ratio = (2 - threshold) / threshold
    low, high = math.ceil(min(sizes) / ratio), math.floor(max(sizes) * ratio)
    every = sorted({x for _, b in known for x in b})

    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    paragraphs = F.when(text.rlike(r"\n[ \t\r]*\n"), F.split(text, r"\n[ \t\r]*\n")).otherwise(F.array().cast("array<string>"))
    tagged = lambda kind, parts: F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("unit")))
    units = docs.select(F.col(id_col).alias("id"), F.explode(F.concat(tagged("line", lines), tagged("paragraph", paragraphs), tagged("text", F.array(text)))).alias("u"))
    # explode(array(x)) keeps x as a computed column: without it every use of x would compute it again
    units = units.select("id", "u.kind", F.explode(F.array(words_of("u.unit"))).alias("w")).where(F.size("w") > low)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    units = units.select("id", "kind", F.explode(F.array(pairs)).alias("b"))
    units = units.where(F.exists("b", lambda x: x.isin(every)))
    units = units.select(F.monotonically_increasing_id().alias("uid"), "id", "kind", F.array_distinct("b").alias("b"))
    units = units.withColumn("n", F.size("b")).where(F.col("n").between(low, high))
    # sizes that are too far apart prune a template before its bigrams are counted
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(i, name, len(b), math.ceil(len(b) / ratio), math.floor(len(b) * ratio), x) for i, (name, b) in enumerate(known) for x in b],
        "template int, license string, size int, low int, high int, bigram string",
    )
    shared = units.select("uid", "id", "kind", "n", F.explode("b").alias("bigram")).join(F.broadcast(table), "bigram")
    shared = shared.where("n between low and high").groupBy("uid", "id", "kind", "n", "template", "license", "size").agg(F.count(F.lit(1)).alias("both"))
    scored = shared.withColumn("dice", 2.0 * F.col("both") / (F.col("n") + F.col("size"))).where(F.col("dice") >= threshold)
    hits = scored.groupBy("uid", "id", "kind").agg(F.max(F.struct("dice", "license")).alias("m"))
    return hits.groupBy(F.col("id").alias(id_col), F.col("m.license").alias("license")).agg(
        F.count_if(F.col("kind") == "line").alias("n_lines"), F.count_if(F.col("kind") == "paragraph").alias("n_paragraphs"),
        F.bool_or(F.col("kind") == "text").alias("whole_text"), F.round(F.max("m.dice"), 6).alias("best_dice"),
    )
