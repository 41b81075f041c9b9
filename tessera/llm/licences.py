"""Licence scans: Dice coefficient over word bigrams between stretches of normalised text and licence templates.

A unit is a stretch of as many words as the template has, or fewer where the text ends, wherever lines break; it
starts at a bigram of the template. Dice >= t needs t / (2 - t) of the template's bigrams in the unit, and a unit of
at least that share of its size. So a text that lacks all of a few words, each template's *anchors*, is out before it
is normalised: they are chosen such that without them too few bigrams are left. The bigrams of other texts meet
those of the templates by a hash join, and sliding windows over the hits give each unit's Dice.

Of units of related templates that start close to each other the best one counts, so that a notice is named after the
licence that it fits best. Everything is built-in expressions; only hits are shuffled.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8
WORD = "[^a-z0-9]+"
#: Templates of at least this Dice with each other, or with a third one, are relatives.
RELATED = 0.4

_PERMIT = "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
_ISC = "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
_BSD_HEAD = "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = " this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
_APACHE = "licensed under the apache license, version 2.0 (the \"license\"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license."
_GNU = "this {thing} is free software; you can redistribute it and/or modify it under the terms of the gnu {kind}general public license as published by the free software foundation; either version {version} of the license, or (at your option) any later version. this {thing} is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu {kind}general public license for more details."
_GNU_SHORT = "this work is licensed under the gnu {kind}general public license version {version}"
_UNLICENSE = "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_EPL = "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"
_CC0 = "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"
_ZLIB = "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: the origin of this software must not be misrepresented; you must not claim that you wrote the original software. altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. this notice may not be removed or altered from any source distribution."
_FAMILY = (("GPL-2.0", "", "program", "2"), ("GPL-3.0", "", "program", "3"), ("LGPL-2.1", "lesser ", "library", "2.1"), ("LGPL-3.0", "lesser ", "program", "3"), ("AGPL-3.0", "affero ", "program", "3"))
#: Texts of public licences and the notices that stand for them.
TEMPLATES = (
    ("MIT", _PERMIT),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("BSD-2-Clause", "licensed under the bsd 2 clause license"),
    ("BSD-3-Clause", "licensed under the bsd 3 clause license"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    *((name, _GNU.format(kind=kind, thing=thing, version=version)) for name, kind, thing, version in _FAMILY),
    *((name, _GNU_SHORT.format(kind=kind, version=version)) for name, kind, _, version in _FAMILY),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/."),
    ("EPL-2.0", _EPL),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("CC0-1.0", _CC0),
    ("CC-BY-4.0", "licensed under cc by 4 0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
)


def words_of(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def families(templates) -> list[int]:
    """For each template the first one that it is related to, by steps or directly."""
    sets, out = [set(bigrams_of(t)) for _, t in templates], list(range(len(templates)))
    for k, a in enumerate(sets):
        for i in range(k):
            if 2 * len(a & sets[i]) >= RELATED * (len(a) + len(sets[i])):
                out = [min(out[i], out[k]) if f in (out[i], out[k]) else f for f in out]
    return out


def needed(size: int, least: float) -> int:
    """Bigrams of a template of `size` that a unit needs for a Dice of `least`, whatever its own size."""
    return math.ceil(size * least / (2 - least) - 1e-9)


def anchors(templates, least: float) -> list[str]:
    """Words of which every unit that reaches `least` with some template has one: for each template the bigrams without
    any of them are too few. Chosen one by one by what they cover, long ones first of all."""
    rest = [set(bigrams_of(t)) for _, t in templates]
    room = [len(g) - needed(len(g), least) for g in rest]
    chosen: list[str] = []
    covered = [0] * len(rest)
    while any(c <= r for c, r in zip(covered, room, strict=True)):
        gain: Counter = Counter()
        for g, c, r in zip(rest, covered, room, strict=True):
            for word, n in Counter(w for x in g for w in set(x.split())).items():
                gain[word] += min(n, max(0, r + 1 - c))
        word = max(sorted(gain), key=lambda w: gain[w] / (1 if len(w) > 5 else 3 if len(w) > 3 else 12))
        chosen.append(word)
        for k, g in enumerate(rest):
            gone = {x for x in g if word in x.split()}
            covered[k] += len(gone)
            rest[k] = g - gone
    return chosen


def normalised(text: Column) -> Column:
    """Lower-case ASCII words of a text, parted by one space."""
    return F.trim(F.regexp_replace(F.lower(text), WORD, " "))


TABLE = "array<struct<gram:string,template:int,licence:string,words:int,size:int,least:int,family:int,reach:int>>"


def template_grams(templates, least: float = DICE) -> list[dict]:
    """A row for each bigram of each template: with its words, distinct bigrams, those that a unit needs, family and the words of the longest one in it."""
    related, words = families(templates), [len(words_of(t)) for _, t in templates]
    reach = {f: max(w for w, g in zip(words, related, strict=True) if g == f) for f in related}
    return [{"gram": g, "template": k, "licence": name, "words": words[k], "size": len(grams), "least": needed(len(grams), least), "family": related[k], "reach": reach[related[k]]} for k, (name, text) in enumerate(templates) for grams in [bigrams_of(text)] for g in grams]


def scan(docs: DataFrame, templates=TEMPLATES, least: float = DICE) -> DataFrame:
    """A row for each document and licence found in it: doc_id, licence, dice, template, first_word, n_units.

    first_word is the number of the unit's first word in the text, from 0; the best unit is named (ties: first template,
    then first word), n_units counts the units that are the best of their place. A unit's bigrams that the template
    has count once, others one by one. Wants doc_id (long) and text. A null text or doc_id finds nothing; rows with
    one doc_id are scanned each by itself and reported as one document. Without hits or rows there are no rows.
    """
    text = F.col("text").cast("string")
    anchored = F.lower(text).rlike(f"(?<![a-z0-9])(?:{'|'.join(sorted(anchors(templates, least)))})(?![a-z0-9])")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter(F.col("doc_id").isNotNull() & anchored)
    # copies of a row are one: the key tells rows of one doc_id apart
    words = rows.select("doc_id", F.xxhash64("text").alias("key"), F.split(normalised(F.col("text")), " ").alias("words"))
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = words.select("doc_id", "key", (F.size("words") - 1).alias("n"), F.posexplode(pairs).alias("at", "gram")).filter("gram is not null")
    # as many rows as the templates have bigrams
    known = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(template_grams(templates, least))), TABLE)))
    # a text with fewer bigrams than every unit of a template needs can't hold one; nor can one that shares too few with it anywhere
    sized = grams.join(F.broadcast(known), "gram").filter("n >= least")
    hits = sized.groupBy("doc_id", "key", "n", "at", "gram", "template", "licence", "words", "size", "least", "family", "reach").count().drop("count")
    hits = hits.withColumn("anywhere", F.expr("size(collect_set(gram) over (partition by doc_id, `key`, template))")).filter("anywhere >= least")
    unit = "over (partition by doc_id, `key`, template order by at / (words - 1) range between current row and 0.9999D following)"
    met = hits.withColumns({"shared": F.expr(f"size(collect_set(gram) {unit})"), "all": F.expr(f"count(1) {unit}")})
    size = F.least(F.col("words") - 1, F.col("n") - F.col("at")) - F.col("all") + F.col("shared")
    found = met.withColumn("dice", F.lit(2.0) * F.col("shared") / (F.col("size") + size)).filter(F.col("dice") >= least)
    rank = F.struct("dice", (-F.col("template")).alias("t"), (-F.col("at")).alias("a"))
    place = "over (partition by doc_id, `key`, family order by at / reach range between 0.5D preceding and 0.5D following)"
    best = found.withColumn("rank", rank).withColumn("top", F.expr(f"max(rank) {place}")).filter("rank = top")
    out = best.groupBy("doc_id", "licence").agg(F.max("rank").alias("b"), F.count(F.lit(1)).alias("n_units"))
    return out.select("doc_id", "licence", F.round("b.dice", 6).alias("dice"), (-F.col("b.t")).alias("template"), (-F.col("b.a")).alias("first_word"), "n_units")


def sql(templates=TEMPLATES, least: float = DICE) -> str:
    """The scan as DuckDB SQL over documents."""
    rows = ", ".join("('{gram}', {template}, '{licence}', {words}, {size}, {family}, {reach})".format(**r) for r in template_grams(templates, least))
    unit = "(PARTITION BY doc_id, text, template ORDER BY pos RANGE BETWEEN CURRENT ROW AND words - 2 FOLLOWING)"
    return f"""
WITH t(gram, template, licence, words, size, family, reach) AS (VALUES {rows}),
d AS (SELECT DISTINCT doc_id, text, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, text, len(w) - 1 AS n, unnest(range(len(w) - 1)) AS pos, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS gram FROM d),
met AS (SELECT *, count(DISTINCT gram) OVER {unit} AS shared, count(*) OVER {unit} AS every FROM g JOIN t USING (gram)),
found AS (SELECT *, 2.0::DOUBLE * shared / (size + least(words - 1, n - pos) - every + shared) AS dice FROM met),
ranked AS (SELECT *, {{'d': dice, 't': -template, 'a': -pos}} AS rank FROM found WHERE dice >= {least!r}::DOUBLE),
best AS (SELECT *, max(rank) OVER (PARTITION BY doc_id, text, family ORDER BY pos::DOUBLE / reach RANGE BETWEEN 0.5::DOUBLE PRECEDING AND 0.5::DOUBLE FOLLOWING) AS top FROM ranked)
SELECT doc_id, licence, round(max(rank).d, 6) AS dice, (-max(rank).t)::INTEGER AS template, (-max(rank).a)::INTEGER AS first_word, count(*) AS n_units
FROM best WHERE rank = top GROUP BY doc_id, licence"""
