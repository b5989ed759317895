"""Licence labels from a positional index of rare words, with DataFrame functions only.

A template is a licence's notice, of some ten to a hundred words, or a short name, with the key phrases of which one must stand whole in its place.
The index posts each template under its words of highest IDF in the template library, with their places in it, dealt in turn to two
halves.  A file's words that are in the index are looked up; each gives templates and where these would begin.  Beginnings on which words of
both halves agree are candidates, so that a notice is found by any part that holds two of its rare words and a key phrase.  A
template's label is given where a key phrase is whole, and the score is the share of the template's words that stand in their places.

Every step works on one row: no explode, no join and no shuffle, so hot sources and long files don't
matter.  Files without any indexed word, nearly all, are not looked at further.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What GNU notices say around the name of their licence.
_GNU = "{0} is free software you can redistribute it and or modify it under the terms of the gnu {1} as published by the free software foundation either version {2} of the license or at your option any later version {0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {1} for more details"

#: Labels, words of the notice, and its key phrases (none: the whole); those of the first ``BASE_TEMPLATES`` are counted as places.
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", "under the mit license", ()),
    ("apache-2", "apache license version 2", ()),
    ("cc-by-nc", "cc by nc", ()),
    ("cc-by-sa", "cc by sa", ()),
    ("cc-by-nd", "cc by nd", ()),
    ("cc0", "cc0 1 0 universal", ()),
    ("gpl-2", "gnu general public license version 2", ()),
    ("gpl-3", "gnu general public license version 3", ()),
    ("lgpl", "gnu lesser general public license", ()),
    ("agpl-3", "gnu affero general public license version 3", ()),
    ("mpl-2", "mozilla public license version 2", ()),
    ("epl", "eclipse public license", ()),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        ("permission is hereby granted free of charge to any person", "copy modify merge publish distribute sublicense and or sell copies of the software"),
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2", "www apache org licenses license 2 0"),
    ),
    ("gpl-2", _GNU.format("this program", "general public license", "2"), ("either version 2 of the license",)),
    ("gpl-3", _GNU.format("this program", "general public license", "3"), ("either version 3 of the license",)),
    ("lgpl", _GNU.format("this library", "lesser general public license", "2 1"), ("gnu lesser general public license",)),
    ("agpl-3", _GNU.format("this program", "affero general public license", "3"), ("gnu affero general public license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"),
    ),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("to endorse or promote products derived from this software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ("mozilla public license v 2 0",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", ("eclipse public license 2 0",)),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("this is free and unencumbered software released into the public domain",),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("including commercial applications and to alter it and redistribute it freely",),
    ),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
)
BASE = ("mit", "apache-2", "cc-by-nc")
BASE_TEMPLATES = 3
#: Words of a template that are posted, at most.
POSTED = 8

#: Fixed value: what is no part of a word.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """Words, the places of the posted ones by half, and key phrases as (place, length)."""

    words: list[str]
    posts: tuple[list[int], list[int]]
    keys: list[tuple[int, int]]


def library(templates=TEMPLATES) -> list[Template]:
    """Templates with their words of highest IDF (ties: the longer word, then the earlier), each by its first place."""
    words = [text.split() for _, text, _ in templates]
    df = Counter(w for ws in words for w in set(ws))
    out = []
    for ws, (_, _, phrases) in zip(words, templates, strict=True):
        rare = sorted({w: ws.index(w) for w in ws}.items(), key=lambda p: (-math.log(len(words) / df[p[0]]), -len(p[0]), p[1]))[:POSTED]
        keys = []
        for phrase in phrases or (" ".join(ws),):
            key = phrase.split()
            keys.append((next(i for i in range(len(ws)) if ws[i : i + len(key)] == key), len(key)))
        out.append(Template(ws, ([at for _, at in rare[::2]], [at for _, at in rare[1::2]]), keys))
    return out


def _map(entries: dict[str, list[tuple[int, int]]]) -> Column:
    """A literal map: word → array of (template, place of the word in it)."""
    flat: list[Column] = []
    for word, posts in sorted(entries.items()):
        flat += [F.lit(word), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(at).alias("at")) for t, at in posts))]
    return F.create_map(*flat)


def scanned(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base: int = BASE_TEMPLATES) -> DataFrame:
    """``(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, places)`` for each row.

    Words are stretches of ASCII letters (lower-cased) and digits and of any characters beyond ASCII.
    ``n_base`` counts places of the first ``base`` templates, whole phrases, ``first_word`` and ``last_word`` are their
    smallest and largest beginning (words from 0), else null.  ``labels`` are those of all templates with a whole key phrase; both lists are distinct, sorted and
    comma-joined.  ``score`` is the largest share of a template's words found in their places at a candidate beginning: 1 where one
    is whole, 0 without a candidate.  ``places`` lists templates with a whole key phrase as (label, start, share); a start is negative where the
    notice's beginning is cut off.  A null or empty text has no words.  Repeated rows come back as often; other columns are ignored; an empty table stays empty.
    """
    lib = library(templates)
    halves: list[dict[str, list[tuple[int, int]]]] = [{}, {}]
    for t, template in enumerate(lib):
        for k in (0, 1):
            for at in template.posts[k]:
                halves[k].setdefault(template.words[at], []).append((t, at))
    indexed = sorted({*halves[0], *halves[1]})
    phrase = F.array(*(F.array(*map(F.lit, template.words)) for template in lib))
    key = F.array(*(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in template.keys)) for template in lib))
    label = F.array(*(F.lit(name) for name, _, _ in templates))

    plain = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = files.select(F.col(id_col).alias("id"), F.split(plain, BREAKS).alias("parts"))
    empty_first = (F.element_at("parts", 1) == "").cast("int")
    rows = rows.select("id", "parts", empty_first.alias("skip"), F.arrays_overlap("parts", F.array(*map(F.lit, indexed))).alias("met"))
    ends_empty = F.when(F.size("parts") > 1, (F.element_at("parts", -1) == "").cast("int")).otherwise(0)
    rows = rows.select("id", "skip", (F.size("parts") - F.col("skip") - ends_empty).cast("long").alias("n_words"), F.when(F.col("met"), F.col("parts")).alias("parts"))

    spots = F.transform("parts", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    spots = F.filter(spots, lambda s: s["w"].isin(*indexed))
    rows = rows.select("id", "skip", "n_words", "parts", spots.alias("spots"))

    def begins(k: int) -> Column:
        posts = _map(halves[k])
        hits = F.transform("spots", lambda s: F.transform(F.coalesce(F.try_element_at(posts, s["w"]), F.array().cast("array<struct<t:int,at:int>>")), lambda p: F.struct(p["t"].alias("t"), (s["i"] - p["at"]).cast("int").alias("i"))))
        return F.flatten(hits)

    rows = rows.select("id", "skip", "n_words", "parts", F.array_intersect(begins(0), begins(1)).alias("both"))

    def there(c: Column) -> Column:
        """Whether each of the template's words stands at the candidate; a place before the text has none."""
        return F.transform(F.element_at(phrase, c["t"] + 1), lambda w, k: F.coalesce((c["i"] + k >= F.col("skip")) & (F.get("parts", F.greatest(c["i"] + k, F.lit(0))) == w), F.lit(False)))

    found = F.transform("both", lambda c: F.struct(c["t"].alias("t"), (c["i"] - F.col("skip")).alias("start"), there(c).alias("there")))
    rows = rows.select("id", "n_words", F.coalesce(found, F.array().cast("array<struct<t:int,start:int,there:array<boolean>>>")).alias("found"))
    share = lambda c: F.size(F.filter(c["there"], lambda x: x)) / F.size(c["there"])
    keyed = lambda c: F.exists(F.element_at(key, c["t"] + 1), lambda q: F.forall(F.slice(c["there"], q["a"] + 1, q["n"]), lambda x: x))
    judged = F.transform("found", lambda c: F.struct(c["t"].alias("t"), c["start"].alias("start"), share(c).alias("share"), keyed(c).alias("keyed")))
    rows = rows.select("id", "n_words", judged.alias("judged"))
    whole = F.filter("judged", lambda c: c["keyed"])
    rows = rows.select("id", "n_words", whole.alias("whole"), F.coalesce(F.array_max(F.transform("judged", lambda c: c["share"])), F.lit(0.0)).alias("score"))
    based = F.filter("whole", lambda c: c["t"] < base)
    starts = F.transform(based, lambda c: c["start"].cast("long"))
    named = lambda cs: F.array_join(F.array_sort(F.array_distinct(F.transform(cs, lambda c: F.element_at(label, c["t"] + 1)))), ",")
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(based).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(based).alias("base_labels"),
        named(F.col("whole")).alias("labels"),
        "score",
        F.transform("whole", lambda c: F.struct(F.element_at(label, c["t"] + 1).alias("label"), c["start"].alias("start"), c["share"].alias("share"))).alias("places"),
    )


def oracle(templates=TEMPLATES, base: int = BASE_TEMPLATES) -> str:
    """DuckDB SQL for the columns of the query."""
    lib = library(templates)
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ",\n    ".join(f"({t}, '{name}', {quoted(x.words)}, {[{'a': a, 'n': n} for a, n in x.keys]})" for t, ((name, _, _), x) in enumerate(zip(templates, lib, strict=True)))
    posts = ",\n    ".join(f"({half}, {t}, '{x.words[at]}', {at})" for t, x in enumerate(lib) for half in (0, 1) for at in x.posts[half])
    return f"""
WITH lib(t, label, words, keys) AS (VALUES
    {rows}),
posts(half, t, word, place) AS (VALUES
    {posts}),
d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
spots AS (SELECT r, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS i FROM d WHERE list_has_any(w, (SELECT list(DISTINCT word) FROM posts))),
begins AS (SELECT r, t, i - place AS start FROM spots JOIN posts USING (word) GROUP BY 1, 2, 3 HAVING count(DISTINCT half) = 2),
cand AS (
  SELECT r, t, label, start, keys, list_transform(generate_series(1, len(words)), lambda k: CASE WHEN start + k >= 1 THEN coalesce(w[start + k] = words[k], false) ELSE false END) AS ok
  FROM begins JOIN lib USING (t) JOIN d USING (r)),
judged AS (
  SELECT r, t, label, start, len(list_filter(ok, lambda x: x)) / len(ok) AS share, len(list_filter(keys, lambda q: len(list_filter(ok[q.a + 1 : q.a + q.n], lambda x: x)) = q.n)) > 0 AS keyed FROM cand),
per AS (
  SELECT r,
    count(*) FILTER (keyed AND t < {base}) AS n_base,
    min(start) FILTER (keyed AND t < {base}) AS first_word,
    max(start) FILTER (keyed AND t < {base}) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (keyed AND t < {base})), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label) FILTER (keyed)), ',') AS labels,
    max(share) AS score
  FROM judged GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN per USING (r)
"""
