"""Licence scan by a positional index of rare words, in DataFrame functions only.

The index holds the words of whole licence texts with their positions and an IDF over the
texts. Of a text that may hold licence words (a plain search decides), each
template's rarest words are looked up, whatever else the text has; each hit votes for its template and the place where it
would begin (position in the text less position in the template). A template whose
votes at one place, weighted by IDF, reach a share of what those words could give is
found if its key phrase stands in the text as well. The fixed phrases are searched word by
word in the same texts, at all places.

All of it happens within a row: no shuffle, and nothing depends on ids.

Defined cases: a null text is empty; repeated rows each give a row; a null doc_id stays null;
other columns aren't read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, in a Java pattern; the text is in lower case by then.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The texts of public licences, or the notices that they ask files to carry, and a phrase that each must hold. A label is
#: what stands before a slash. Another list can be passed.
TEMPLATES = {
    "mit": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "permission is hereby granted free of charge to any person",
    ),
    "bsd-2": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
        HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        "redistribution and use in source and binary forms",
    ),
    "bsd-3": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor
        the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES.""",
        "may be used to endorse or promote products derived from this software",
    ),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
        "with or without fee is hereby granted",
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
        as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
        "the origin of this software must not be misrepresented",
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
        and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
        our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights
        to this software under copyright law.""",
        "free and unencumbered software",
    ),
    "boost-1": (
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and
        to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
        unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language
        processor.""",
        "to any person or organization obtaining a copy of the software",
    ),
    "apache-2": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "licensed under the apache license",
    ),
    "gpl-2": (
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "either version 2 of the license",
    ),
    "gpl-3": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "either version 3 of the license",
    ),
    "lgpl": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
        "gnu lesser general public license",
    ),
    "gpl-3/line": ("Licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    "gpl-2/line": ("Licensed under the GNU General Public License, version 2", "gnu general public license version 2"),
    "mpl-2": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "mozilla public license",
    ),
    "cc-by-nc": (
        """This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this
        license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042,
        USA.""",
        "creative commons attribution noncommercial",
    ),
    "cc-by": (
        """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit
        http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
        "creative commons attribution 4 0",
    ),
    "cc0": (
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
        "waived all copyright and related or neighboring rights",
    ),
}
#: Rare words looked up for a template; the least share of what they could give.
RAREST, MIN_SHARE = 16, 0.6


def template_words(text: str) -> list[str]:
    """The words of a template, as those of a document are taken."""
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text))


def rare_word_index(templates: dict[str, tuple[str, str]]) -> tuple[dict[str, list[tuple[int, int]]], dict[str, float]]:
    """word: (template number, position) of each place; word: IDF over the templates."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, (text, _) in enumerate(templates.values()):
        for position, word in enumerate(template_words(text)):
            postings.setdefault(word, []).append((number, position))
    idf = {word: math.log(1 + len(templates) / len({number for number, _ in places})) for word, places in postings.items()}
    return postings, idf


def rarest_words(templates: dict[str, tuple[str, str]], rarest: int = RAREST) -> dict[str, list[tuple[str, int]]]:
    """Each template's places (word, position) that are looked up: of the words of highest IDF, at first those that it has once."""
    postings, idf = rare_word_index(templates)
    chosen = {}
    for number, label in enumerate(templates):
        own = {w: [p for t, p in places if t == number] for w, places in postings.items()}
        order = sorted((w for w, places in own.items() if places), key=lambda w: (-idf[w], len(own[w]), own[w][0]))
        chosen[label] = [(w, p) for w in order[:rarest] for p in own[w]]
    return chosen


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other."""
    first, *rest = phrase.split()

    def fits(word: Column, at: Column) -> Column:
        return (word == first) & (F.slice(words, at + 2, len(rest)) == F.array(*map(F.lit, rest)))

    return F.filter(F.transform(words, lambda w, i: F.when(fits(w, i), i)), lambda i: i.isNotNull())


def _most_votes(own: Column) -> Column:
    """The largest weight of votes that begin at one place or beside it, in one pass over a template's votes by place.

    The state holds the last place that had votes, and the weights there, one and two places before."""
    double = lambda x: F.lit(x).cast("double")
    start = F.struct(F.lit(-(10**9)).alias("at"), double(0).alias("here"), double(0).alias("back"), double(0).alias("back2"), double(0).alias("most"))

    def step(state: Column, vote: Column) -> Column:
        gap, weight = vote["begin"] - state["at"], vote["weight"]
        here = F.when(gap == 0, state["here"]).otherwise(0.0) + weight
        back = F.when(gap == 0, state["back"]).when(gap == 1, state["here"]).otherwise(0.0)
        back2 = F.when(gap == 0, state["back2"]).when(gap == 1, state["back"]).when(gap == 2, state["here"]).otherwise(0.0)
        # Votes two places apart meet only around a place that has votes itself.
        near = here + back + F.when(back > 0, back2).otherwise(0.0)
        return F.struct(vote["begin"].alias("at"), here.alias("here"), back.alias("back"), back2.alias("back2"), F.greatest(state["most"], near).alias("most"))

    return F.aggregate(F.array_sort(own), start, step, lambda state: state["most"])


def _found_templates(words: Column, joined: Column, templates: dict[str, tuple[str, str]], rarest: int, min_share: float) -> Column:
    """array<struct<label, score>>."""
    _, idf = rare_word_index(templates)
    labels, chosen = list(templates), rarest_words(templates, rarest)
    kept: dict[str, list[tuple[int, int]]] = {}
    for number, label in enumerate(labels):
        for word, position in chosen[label]:
            kept.setdefault(word, []).append((number, position))
    index = F.create_map(*[x for word, places in sorted(kept.items()) for x in (F.lit(word), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(idf[word]).alias("weight")) for t, p in places]))])

    def votes() -> Column:
        """A vote for each place of a rare word in the text and in a template."""
        at = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda e: e["w"].isin(list(kept)))
        return F.flatten(F.transform(at, lambda e: F.transform(index[e["w"]], lambda q: F.struct(q["t"].alias("t"), (e["i"] - q["p"]).alias("begin"), q["weight"].alias("weight")))))

    def verdict(cast: Column, number: int, label: str) -> Column:
        _, key = templates[label]
        could = sum(idf[w] for w, _ in chosen[label])
        own = F.transform(F.filter(cast, lambda v: v["t"] == number), lambda v: F.struct(v["begin"].alias("begin"), v["weight"].alias("weight")))
        share = F.least(_most_votes(own) / could, F.lit(1.0))
        scored = _let(share, lambda share: F.when(share >= min_share, F.struct(F.lit(label.partition("/")[0]).alias("label"), share.alias("score"))))
        return F.when(F.contains(joined, F.lit(f" {key} ")), scored)

    def verdicts(cast: Column) -> Column:
        return F.array_compact(F.array(*(verdict(cast, number, label) for number, label in enumerate(labels))))

    return _let(votes(), verdicts)


def _may_hold(lowered: Column, phrases: list[str]) -> Column:
    """False where no phrase can stand: each has a word of a small set, or one of its letter pairs at least."""
    left = set(phrases)
    marks = []
    while left:
        long = {w for phrase in left for w in phrase.split() if len(w) > 4}
        if not long:
            break
        mark = max(sorted(long), key=lambda w: (sum(w in phrase.split() for phrase in left), len(w)))
        marks.append(mark)
        left = {phrase for phrase in left if mark not in phrase}
    maybe = F.lit(False)
    for mark in marks:
        maybe = maybe | F.contains(lowered, F.lit(mark))
    for phrase in sorted(left):
        words = phrase.split()
        all_words = F.lit(True)
        for word in sorted(set(words), key=len):
            all_words = all_words & F.contains(lowered, F.lit(word))
        maybe = maybe | (all_words & lowered.rlike(GAP.join(map(re.escape, words))))
    return maybe


def license_labels(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, rarest: int = RAREST, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    keys = [key for _, key in templates.values()] + list(phrases)
    maybe = _let(F.lower(F.coalesce(F.col("text"), F.lit(""))), lambda lowered: _may_hold(lowered, keys))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.size(F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long").alias("n_words"), maybe.alias("maybe"))

    def scanned(words: Column) -> Column:
        places = F.array(*[F.struct(F.lit(label).alias("label"), _starts(words, phrase).alias("at")) for phrase, label in phrases.items()])
        return F.struct(places.alias("places"), _let(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), lambda joined: _found_templates(words, joined, templates, rarest, min_share)).alias("found"))

    words = F.array_remove(F.split(F.translate("text", upper, lower), GAP), "")
    rows = rows.withColumn("scan", F.when(F.col("maybe"), _let(words, scanned)))
    places = F.filter("scan.places", lambda p: F.size(p["at"]) > 0)
    rows = rows.select("doc_id", "n_words", F.coalesce(places, F.array()).alias("places"), F.coalesce("scan.found", F.array()).alias("found"))
    at = F.flatten(F.transform("places", lambda p: p["at"]))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    more = F.transform("found", lambda f: f["label"])
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"), score.alias("score"),
    )
