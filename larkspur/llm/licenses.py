"""License scans with DataFrame functions only.

Texts are cut into sentences and lines.  A sentence is a sparse TF-IDF vector; its
cosine with each template's is computed inside its row, for sentences that hold one
of the terms without which no cosine can reach the threshold.  Lines and paragraphs are
compared with the usual headers, and whole files and their beginnings with whole
license texts, in the same way.  A file whose words are mostly such parts, or whose
name says so, is a license file: files without a license of their own inherit from
the license files of the nearest ancestor directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import stage

#: Notices as licences ask for them at the head of files (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_CC = {"": "Attribution", "-SA": "Attribution-ShareAlike", "-NC": "Attribution-NonCommercial", "-ND": "Attribution-NoDerivatives", "-NC-SA": "Attribution-NonCommercial-ShareAlike", "-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "CC0-1.0", *(f"CC-BY{k}-4.0" for k in _CC)]
_FREE = "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
_GNU = [("GPL", "2.0", "", "June 1991"), ("GPL", "3.0", "", "29 June 2007"), ("LGPL", "2.1", "Lesser ", "February 1999"), ("LGPL", "3.0", "Lesser ", "29 June 2007"), ("AGPL", "3.0", "Affero ", "19 November 2007")]
#: Usual headers, SPDX lines and headings of license files, as pairs: each is one line or paragraph of a file.
HEADERS = [
    *((k, f"SPDX-License-Identifier: {k}") for k in _SPDX),
    *((f"{a}-{v}", f"SPDX-License-Identifier: {a}-{v}{x}") for a, v, _, _ in _GNU for x in ("", "+", "-only", "-or-later")),
    *((f"{a}-{v}", _FREE.format("This program" if a != "LGPL" else "This library", *x[:1], k, *x[1:], v.removesuffix(".0"))) for a, v, k, _ in _GNU for x in (":;", ",,")),
    *((f"{a}-{v}", f"GNU {k}General Public License Version {v.removesuffix('.0')}, {d}") for a, v, k, d in _GNU),
    *((f"CC-BY{k}-4.0", f"This work is licensed under {x} Creative Commons {n} 4.0 International License.") for k, n in _CC.items() for x in ("a", "the")),
    *((f"CC-BY{k}-4.0", f"Creative Commons {n} 4.0 International Public License") for k, n in _CC.items()),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
]
#: A file may begin with so many words more than a license text: holders' names and the like.
SLACK = 8
#: Terms with this inverse document frequency or less stand in one file of fifty or more.
COMMON = 1 + math.log(50)
NAMES = r"(?i)(^|/)(LICEN[CS]E|COPYING|NOTICE)(\.[A-Za-z]+)?$"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
SENTENCE = r"(?<=[.!?])[\x20\x09-\x0D]+|[\n\r]+"
#: Between paragraphs are lines without letters and digits.
PARAGRAPH = r"(?>\r\n|\n|\r)[^A-Za-z0-9\n\r]*(?>\r\n|\n|\r)"


def license_texts() -> list[tuple[str, str]]:
    """Whole texts of licenses, without their holders' names."""
    return [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def _terms(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def weights(files: DataFrame, templates: list[str], text: str) -> tuple[dict, float]:
    """Inverse document frequency of each template term over all files, and of a term that no file has."""
    vocabulary = sorted({t for x in templates for t in _terms(x)})
    known = F.expr(_split(vocabulary))
    rare = F.array_intersect(_words(F.coalesce(F.col(text), F.lit(""))), known)
    got = files.select(F.explode(F.array_append(rare, F.lit(""))).alias("t")).groupBy("t").count().collect()
    n = {r["t"]: r["count"] for r in got}
    total = n.get("", 0)
    idf = {t: math.log((1 + total) / (1 + n.get(t, 0))) + 1 for t in vocabulary}
    return idf, math.log(1 + total) + 1


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for k in sorted(d) for x in (k, float(d[k]))])


def _split(terms: list[str]) -> str:
    return "split('" + " ".join(terms) + "', ' ')"


def _index(d: dict) -> str:
    """SQL of a map of maps by first character: Spark looks through a map's keys one by one."""
    first = sorted({k[0] for k in d})
    part = lambda c: sorted(k for k in d if k[0] == c)
    maps = [f"map_from_arrays({_split(part(c))}, cast({_split([repr(float(d[k])) for k in part(c)])} AS array<double>))" for c in first]
    return f"map_from_arrays({_split(first)}, array({', '.join(maps)}))"


def _look(index: Column, term: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.try_element_at(index, F.substring(term, 1, 1)), term), F.lit(default))


def _needed(vector: dict, least: float) -> set:
    """Terms of which a sentence must have one: without them the cosine stays under least."""
    rest, out = sum(w * w for w in vector.values()), set()
    whole = rest
    for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if rest < least * least * whole * (1 - 1e-9):
            break
        out.add(t)
        rest -= w * w
    return out


def _shared(vectors: list[dict], least: float, idf: dict) -> list[str]:
    """As _needed for all vectors together: rare terms that many of them have come first."""
    n, out = Counter(t for v in vectors for t in v), set()
    for v in vectors:
        rest = whole = sum(w * w for w in v.values())
        for t in sorted(v, key=lambda t: (idf[t] <= COMMON, -n[t] * v[t] ** 2, t)):
            if rest < least * least * whole * (1 - 1e-9):
                break
            out.add(t)
            rest -= v[t] ** 2
    return sorted(out)


def _fewest(vector: dict, least: float) -> int:
    """With fewer distinct terms of the vector, no cosine reaches least."""
    whole, got = sum(w * w for w in vector.values()), 0.0
    for k, w in enumerate(sorted(vector.values(), reverse=True), 1):
        got += w * w
        if got >= least * least * whole * (1 - 1e-9):
            return k
    return len(vector)


def scan(files: DataFrame, text: str = "text", path: str = "path", templates: dict | None = None, least: float = 0.75, share: float = 0.5, headers: list | None = None, texts: list | None = None) -> DataFrame:
    """All rows and columns of files with license, license_score, license_how and license_dir.

    license_how is ``own`` (the best cosine of a sentence with a template, of a line or
    paragraph with a header, or of the whole file or its beginning with a license text
    is at least ``least``; ties: the first name), ``inherited`` (license_dir is the nearest
    ancestor directory with a license file; of several licenses there, the first
    name) or ``none`` (license is null, the score 0).  Null and empty texts have no
    license of their own; a null path has no ancestors.  Repeated rows stay; columns
    of files with the added names are replaced.
    """
    templates = templates or TEMPLATES
    headers, texts = HEADERS if headers is None else headers, license_texts() if texts is None else texts
    added = ("license", "license_score", "license_how", "license_dir")
    mine = ("__own", "__dir", "__is", "__license", "__from")
    files = files.drop(*added, *mine)
    idf, oov = weights(files, [*templates.values(), *(x for _, x in [*headers, *texts])], text)
    vectors = {n: {t: c * idf[t] for t, c in Counter(_terms(x)).items()} for n, x in templates.items()}
    needed = sorted(set().union(*[_needed(v, least) for v in vectors.values()]))
    some, own = _own(text, vectors, needed, headers, texts, idf, oov, least)
    # few files have one of the terms; stored, texts are searched for terms once, and directories and rows are read without them
    scored = stage(files.withColumn("__own", F.when(some, own)), "licensed")
    has = F.col("__own.license").isNotNull()
    directory = F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1)
    scored = scored.withColumns({"__dir": F.when(F.col(path).isNotNull(), directory), "__is": has & F.coalesce((F.col("__own.words") >= share * F.col("__own.all")) | F.col(path).rlike(NAMES), F.lit(False))})
    # directories are far fewer than files
    licensed = scored.where("__is and __dir is not null").groupBy("__dir").agg(F.min("__own.license").alias("__license"))
    dirs = scored.where(~has & F.col("__dir").isNotNull()).select("__dir").distinct()
    steps = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("up")))
    up = dirs.select("__dir", F.inline(above)).withColumn("n", F.length("up"))
    # the second key makes both sides exchange their rows, so that a hot directory's can be split
    found = up.join(licensed.select(F.col("__dir").alias("up"), "__license", F.length("__dir").alias("n")), ["up", "n"])
    nearest = found.groupBy("__dir").agg(F.max_by(F.struct(F.col("up").alias("dir"), F.col("__license").alias("license")), "depth").alias("__from"))
    out = scored.withColumn("__n", F.length("__dir")).join(nearest.withColumn("__n", F.length("__dir")), ["__dir", "__n"], "left")
    given = F.when(~has, F.col("__from.license"))
    return out.select(
        *files.columns,
        F.coalesce("__own.license", given).alias("license"),
        F.coalesce("__own.score", F.lit(0.0)).alias("license_score"),
        F.when(has, "own").when(given.isNotNull(), "inherited").otherwise("none").alias("license_how"),
        F.when(~has, F.col("__from.dir")).alias("license_dir"),
    )


def _norm(words: Column, weight) -> Column:
    """Root of the sum of squares of tf * idf; words are sorted, so equal ones stand together."""
    begin = F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sum"))
    square = lambda a: F.pow(a["n"] * weight(a["t"]), F.lit(2.0))
    step = lambda a, x: F.when(a["t"] == x, F.struct(a["t"].alias("t"), (a["n"] + 1).alias("n"), a["sum"].alias("sum"))).otherwise(F.struct(x.alias("t"), F.lit(1).cast("long").alias("n"), (a["sum"] + square(a)).alias("sum")))
    return F.aggregate(words, begin, step, lambda a: F.sqrt(a["sum"] + square(a)))


def _any(needed: list) -> str:
    return "(?i)(?<![a-z0-9])(" + "|".join(re.escape(t) for t in needed) + ")(?![a-z0-9])"


class _Long:
    """Headers or license texts, as one constant: too many terms for an expression each."""

    def __init__(self, pairs: list, idf: dict, oov: float, least: float):
        vectors = [{t: c * idf[t] for t, c in Counter(_terms(x)).items()} for _, x in pairs]
        self.needed = _shared(vectors, least, idf)
        known = F.expr(_index({t: idf[t] for v in vectors for t in v}))
        self.weight = lambda t: _look(known, t, oov)
        rows = [self._row(n, x, v, idf, least) for (n, x), v in zip(pairs, vectors, strict=True)]
        self.templates = F.expr(f"array({', '.join(rows)})")

    @staticmethod
    def _row(name: str, text: str, v: dict, idf: dict, least: float) -> str:
        own = math.sqrt(sum(w * w for w in v.values()))
        part = _index({t: w * idf[t] / own for t, w in v.items()})
        return f"named_struct('license', '{name}', 'part', {part}, 'terms', {_split(sorted(v))}, 'k', {_fewest(v, least)}, 'n', {len(_terms(text)) + SLACK})"

    def near(self, words: Column) -> Column:
        return F.filter(self.templates, lambda t: F.size(F.array_intersect(words, t["terms"])) >= t["k"])

    def one(self, words: Column, t: Column) -> Column:
        dot = F.aggregate(words, F.lit(0.0), lambda a, x: a + _look(t["part"], x, 0.0))
        return F.struct(F.round(dot / _norm(words, self.weight), 9).alias("score"), t["license"].alias("license"), F.size(words).alias("words"))

    def best(self, hits: Column, least: float) -> Column:
        """The best of hits, as an array of one or none; ties: the first name."""
        return F.slice(F.array_sort(F.filter(hits, lambda h: h["score"] >= least), lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).otherwise(0)), 1, 1)

    def units(self, parts: Column, least: float) -> Column:
        """The best header of each line or paragraph that has one."""
        words = F.transform(F.filter(parts, lambda s: s.rlike(_any(self.needed))), lambda s: F.sort_array(_words(s)))
        return F.flatten(F.transform(words, lambda w: self.best(F.transform(self.near(w), lambda t: self.one(w, t)), least)))

    def whole(self, text: Column, least: float) -> Column:
        """The best license text of the file as a whole or of its beginning."""
        each = lambda w: lambda t: F.transform(F.array(F.sort_array(w), F.sort_array(F.slice(w, F.lit(1), t["n"]))), lambda u: self.one(u, t))
        return F.flatten(F.transform(F.array(_words(text)), lambda w: self.best(F.flatten(F.transform(self.near(w), each(w))), least)))


def _own(text: str, vectors: dict, needed: list, headers: list, texts: list, idf: dict, oov: float, least: float) -> tuple[Column, Column]:
    """Whether a file has one of the terms, and what it then has: license, score, words of the parts and of all."""
    whole = F.coalesce(F.col(text), F.lit(""))
    any_needed = _any(needed)
    must = F.array(*[F.lit(t) for t in needed])
    # a sentence's words that no notice has weigh as much as words that no file has
    weigh = _map({t: idf[t] for v in vectors.values() for t in v})
    weight = lambda t: F.coalesce(F.try_element_at(weigh, t), F.lit(oov))

    def score(words):
        size = _norm(words, weight)
        def one(name):
            v = vectors[name]
            own = math.sqrt(sum(w * w for w in v.values()))
            part = _map({t: w * idf[t] / own for t, w in v.items()})
            dot = F.aggregate(words, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(part, x), F.lit(0.0)))
            return F.struct(F.round(dot / size, 9).alias("score"), F.lit(name).alias("license"), F.size(words).alias("words"))
        all_ = F.array(*[one(n) for n in sorted(vectors)])
        # the best score; ties: the first name
        return F.aggregate(all_, F.get(all_, F.lit(0)), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))

    sentences = F.split(whole, SENTENCE)
    listed = F.filter(F.transform(F.filter(sentences, lambda s: s.rlike(any_needed)), lambda s: F.sort_array(_words(s))), lambda w: F.arrays_overlap(w, must))
    hits = F.filter(F.transform(listed, score), lambda h: h["score"] >= least)
    none = F.array().cast("array<struct<score:double,license:string,words:int>>")
    kinds = {"notices": F.when(whole.rlike(any_needed), hits)}
    if headers:
        h = _Long(headers, idf, oov, least)
        some = whole.rlike(_any(h.needed))
        kinds |= {"lines": F.when(some, h.units(sentences, least)), "paragraphs": F.when(some, h.units(F.split(whole, PARAGRAPH), least))}
        needed = [*needed, *h.needed]
    if texts:
        x = _Long(texts, idf, oov, least)
        kinds |= {"texts": F.when(whole.rlike(_any(x.needed)), x.whole(whole, least))}
        needed = [*needed, *x.needed]
    better = lambda a, x: F.when((x["score"] > a["score"]) | ((x["score"] == a["score"]) & (x["license"] < a["license"])), x).otherwise(a)

    def told(o):
        all_ = F.concat(*[o[k] for k in kinds])
        best = F.aggregate(all_, F.get(all_, F.lit(0)), better)
        # the kinds overlap, so their words are not added up
        inside = F.array_max(F.array(*[F.aggregate(o[k], F.lit(0), lambda a, x: a + x["words"]) for k in kinds]))
        found = F.size(all_) > 0
        return F.struct(F.when(found, best["license"]).alias("license"), F.when(found, best["score"]).alias("score"), F.when(found, inside).alias("words"), F.when(found, F.size(_words(whole))).alias("all"))

    parts = F.struct(*[F.coalesce(c, none).alias(k) for k, c in kinds.items()])
    return whole.rlike(_any(sorted(set(needed)))), F.get(F.transform(F.array(parts), told), F.lit(0))
