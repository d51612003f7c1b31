"""License scan by canonical digests.

A text is brought to a canonical form: A-Z lower-cased, signs for copyright
spelt out, every run of other ASCII characters than letters and digits one
space, equivalent spellings made one, and (for whole texts) lines that only
state a copyright left out. The digest of that form is looked up by a hash
join with the digests of the known texts, brought to the same form.

Units of a document are its whole text, each of its lines and each block of
several lines between empty ones (a line without a word is empty), so a notice
in a longer document is found, reflowed or not, as well as a file that is a
licence. A full licence text is also found inside a longer document: where the
words of a text's head (its first ``HEAD`` words) stand, the digests of the
stretches from there on that are as long as the texts with this head are
looked up. Only documents that hold a word part common to all full texts are
cut into words for it.

The known texts are a fixed list (a few hundred digests, the long texts in
``license_texts``): whole texts meet it in a broadcast hash join, the digests of
lines, blocks and stretches in the row itself. Nothing is shuffled, and every
row is judged by its own text. All work is DataFrame expressions. Of
CC-BY-NC-4.0, AGPL-3.0, LGPL-2.1, EPL-2.0 and Artistic-2.0 the list has notices
only.

Defined results for odd input: NULL text is empty and matches nothing; rows
that repeat a doc_id (or have none) are each judged by their own text; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm.common import text_column

# Licence texts and the notices by which files refer to them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0}Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.

{1}Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

{2}THIS SOFTWARE IS PROVIDED BY THE {3} AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE {4} OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAMES = """{0}Neither the name of {1} nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.

"""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public
domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use
of this software.

Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
# Who disclaims: in the first and in the second place.
_BSD_PARTIES = (("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT OWNER"),
                ("COPYRIGHT HOLDER", "COPYRIGHT HOLDER"), ("REGENTS", "REGENTS"))


def _bsd():
    for one, two, three in (("1. ", "2. ", "3. "), ("* ", "* ", "* ")):
        for a, b in _BSD_PARTIES:
            for title in ("", "BSD 2-Clause License\n\n"):
                yield "BSD-2-Clause", "permissive", title + _BSD.format(one, two, "", a, b)
            for name in ("the copyright holder", "the copyright holders", "the University"):
                for title in ("", "BSD 3-Clause License\n\n"):
                    yield ("BSD-3-Clause", "permissive",
                           title + _BSD.format(one, two, _BSD_NAMES.format(three, name), a, b))


def _read(name: str) -> str:
    return files(__package__).joinpath("license_texts", f"{name}.txt").read_text(encoding="utf-8")


def _long():
    """The texts of ``license_texts``, whole and without what stands around
    their terms (instructions for use, a notice about the publisher)."""
    for name, kind in (("Apache-2.0", "permissive"), ("GPL-2.0", "copyleft"), ("GPL-3.0", "copyleft"),
                       ("LGPL-3.0", "copyleft"), ("MPL-2.0", "copyleft"), ("CC0-1.0", "public-domain"),
                       ("CC-BY-4.0", "attribution"), ("CC-BY-SA-4.0", "copyleft")):
        text, end = _read(name), "END OF TERMS AND CONDITIONS"
        yield name, kind, text
        if end in text:
            yield name, kind, text[:text.index(end)]
            yield name, kind, text[:text.index(end)] + end
        if name.startswith("CC-"):
            yield name, kind, text.split("=" * 71)[2]


# SPDX identifiers by licence (a tag line names one of them).
SPDX = (
    ("MIT", "permissive", ("MIT", "Expat")),
    ("ISC", "permissive", ("ISC",)),
    ("0BSD", "permissive", ("0BSD",)),
    ("Zlib", "permissive", ("Zlib",)),
    ("BSL-1.0", "permissive", ("BSL-1.0",)),
    ("Unlicense", "public-domain", ("Unlicense",)),
    ("Apache-2.0", "permissive", ("Apache-2.0",)),
    ("BSD-2-Clause", "permissive", ("BSD-2-Clause",)),
    ("BSD-3-Clause", "permissive", ("BSD-3-Clause",)),
    ("Artistic-2.0", "permissive", ("Artistic-2.0",)),
    ("GPL-2.0", "copyleft", ("GPL-2.0", "GPL-2.0+", "GPL-2.0-only", "GPL-2.0-or-later")),
    ("GPL-3.0", "copyleft", ("GPL-3.0", "GPL-3.0+", "GPL-3.0-only", "GPL-3.0-or-later")),
    ("LGPL-2.1", "copyleft", ("LGPL-2.1", "LGPL-2.1+", "LGPL-2.1-only", "LGPL-2.1-or-later")),
    ("LGPL-3.0", "copyleft", ("LGPL-3.0", "LGPL-3.0+", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    ("AGPL-3.0", "copyleft", ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")),
    ("MPL-2.0", "copyleft", ("MPL-2.0",)),
    ("EPL-2.0", "copyleft", ("EPL-2.0",)),
    ("CC-BY-4.0", "attribution", ("CC-BY-4.0",)),
    ("CC-BY-SA-4.0", "copyleft", ("CC-BY-SA-4.0",)),
    ("CC-BY-NC-4.0", "noncommercial", ("CC-BY-NC-4.0",)),
    ("CC0-1.0", "public-domain", ("CC0-1.0",)),
)
FULL_TEXTS = (("MIT", "permissive", _MIT), ("ISC", "permissive", _ISC), ("0BSD", "permissive", _ZERO_BSD),
              ("Zlib", "permissive", _ZLIB), ("BSL-1.0", "permissive", _BSL), ("Unlicense", "public-domain", _UNLICENSE),
              *_bsd(), *_long())
LICENSES = (
    ("MIT", "permissive", _MIT),
    ("MIT", "permissive", "MIT License\n\n" + _MIT),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("ISC", "permissive", _ISC),
    ("ISC", "permissive", "ISC License\n\n" + _ISC),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("BSD-3-Clause", "permissive", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "copyleft", "Licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "attribution", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "public-domain", "Licensed under CC0 1.0."),
    ("AGPL-3.0", "copyleft", "Licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "copyleft", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("EPL-2.0", "copyleft", "Licensed under the Eclipse Public License, version 2.0."),
    ("Zlib", "permissive", "Licensed under the zlib License."),
    ("BSL-1.0", "permissive", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BSL),
    ("BSL-1.0", "permissive", "Distributed under the Boost Software License, Version 1.0."),
    ("Artistic-2.0", "permissive", "Licensed under the Artistic License 2.0."),
    ("proprietary", "restricted", "All rights reserved."),
    *((name, kind, f"SPDX-License-Identifier: {tag}") for name, kind, tags in SPDX for tag in tags),
    *FULL_TEXTS[2:],
)
# Words that tell where a full text may begin.
HEAD = 12

# Fixed values: (pattern, replacement) applied in this order to lower-cased lines.
EQUIVALENTS = (
    (r"(?:©|\(c\))", " copyright "),
    ("&", " and "),
    (r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "),
    (r"\blicence", "license"),
    (r"\b(organi|authori|recogni)s", "$1z"),
    (r"\bsub license", "sublicense"),
    (r"\bhttps\b", "http"),
    (r"\b(?:v|ver) ?([0-9])", "version $1"),
    (r"\bcopyright(?: copyright)+\b", "copyright"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Lines that only state a copyright (not those that go on about notices).
STATEMENT = "^(?:copyright(?! (?:notices?|holders?|owners?|laws?)\\b)(?: |$)|all rights reserved$)"


def canonical(line: Column) -> Column:
    """Canonical form of one line."""
    out = F.translate(line, UPPER, LOWER)
    for pattern, to in EQUIVALENTS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(STATEMENT)), " ")


def _known(spark: SparkSession, licenses) -> DataFrame:
    """license, category and canonical form of a fixed list."""
    rows = spark.createDataFrame([(n, c, t) for n, c, t in licenses], "license string, category string, t string")
    rows = rows.select("license", "category", F.filter(
        F.transform(F.split("t", "\n"), canonical), lambda x: x != "").alias("lines"))
    # a text that is a copyright statement throughout stays as it is
    form = F.when(_whole(F.col("lines")) == "", F.array_join("lines", " ")).otherwise(_whole(F.col("lines")))
    return rows.select("license", "category", form.alias("form"))


def known_digests(spark: SparkSession, licenses=LICENSES) -> DataFrame:
    """digest, license, category of the fixed list (bounded by its length).
    Several names for one digest keep the first in name order."""
    return _known(spark, licenses).select(F.sha2("form", 256).alias("digest"), F.struct("license", "category").alias("l")).groupBy(
        "digest").agg(F.min("l").alias("l")).select("digest", "l.license", "l.category")


class _Tables:
    """What a scan looks up, of bounded size: names by digest, and for texts
    inside a document the heads, the numbers of words of the texts with each
    head, and a part of a word that all of them hold."""

    def __init__(self, spark: SparkSession, licenses, full):
        known = known_digests(spark, licenses).collect()
        self.names = {r.digest: f"{r.license}|{r.category}" for r in known}
        forms = {r.form for r in _known(spark, full).select("form").collect()}
        self.inside = [hashlib.sha256(f.encode()).hexdigest() for f in forms]
        self.lengths: dict[str, set[int]] = {}
        for words in (f.split(" ") for f in forms):
            self.lengths.setdefault(" ".join(words[:HEAD]), set()).add(len(words))
        common = reduce(set.__and__, (_parts(f) for f in forms)) if forms else set()
        self.part = max(common, key=lambda p: (len(p), p), default="")


def _parts(form: str, least: int = 4) -> set[str]:
    """Beginnings of the words of a text."""
    return {w[:n] for w in set(form.split(" ")) for n in range(least, len(w) + 1)}


@lru_cache(maxsize=8)
def _tables(spark: SparkSession, licenses, full) -> _Tables:
    return _Tables(spark, licenses, full)


def _digest(words: Column) -> Column:
    return F.sha2(F.array_join(words, " "), 256)


def _texts_inside(form: Column, t: _Tables) -> Column:
    """Digests of the full texts inside the canonical ``form`` of a document."""
    empty = F.array().cast("array<string>")
    if not t.lengths:
        return empty
    firsts = sorted({h.split(" ")[0] for h in t.lengths})
    lengths = F.create_map(*(x for head, n in sorted(t.lengths.items()) for x in (
        F.lit(head), F.array(*map(F.lit, sorted(n))))))
    words = F.split(form, " ")
    starts = F.filter(F.transform(words, lambda w, i: F.when(w.isin(firsts), i + 1)), lambda i: i.isNotNull())

    def at(i: Column) -> Column:
        sizes = F.element_at(lengths, F.array_join(F.slice(words, i, F.lit(HEAD)), " "))
        return F.transform(F.coalesce(sizes, F.array().cast("array<int>")), lambda n: F.when(
            i + n - 1 <= F.size(words), _digest(F.slice(words, i, n))))
    found = F.filter(F.flatten(F.transform(starts, at)), lambda d: d.isin(t.inside))
    return F.when(F.contains(form, F.lit(t.part)), F.array_distinct(found)).otherwise(empty)


def scan_licenses(docs: DataFrame, licenses=LICENSES, full=FULL_TEXTS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_units (matching units), licenses
    (sorted names, comma-joined), categories (likewise), is_license (the
    whole text is a known text). ``full`` are those of ``licenses`` that are
    also looked for inside a text."""
    spark = docs.sparkSession
    t = _tables(spark, tuple(licenses), tuple(full))
    every = docs.select("doc_id", F.transform(F.split(text_column(), "\n"), canonical).alias("every"))
    step = every.select("doc_id", F.filter("every", lambda x: x != "").alias("lines"),
                        F.filter("every", lambda x: ~x.rlike(STATEMENT)).alias("own"))
    step = step.select("doc_id", "lines", F.array_join(F.filter("own", lambda x: x != ""), " ").alias("form"),
                       F.split(F.array_join("own", "\n"), "\n\n+").alias("blocks"))
    blocks = F.transform(F.filter(F.transform("blocks", lambda b: F.btrim(b, F.lit("\n"))), lambda b: F.contains(b, F.lit("\n"))),
                         lambda b: F.translate(b, "\n", " "))
    # a block or text inside that is all of the document is not given twice
    parts = F.array_distinct(F.concat(F.transform(blocks, lambda b: F.sha2(b, 256)), _texts_inside(F.col("form"), t)))
    step = step.select("doc_id", F.sha2("form", 256).alias("whole"),
                       F.transform("lines", lambda x: F.sha2(x, 256)).alias("lines"), parts.alias("parts"))
    step = step.select("doc_id", "whole", F.filter(
        F.concat("lines", F.array_remove("parts", F.col("whole"))), lambda d: d.isin(list(t.names))).alias("units"))
    # the whole text meets the list in a hash join
    step = step.join(F.broadcast(known_digests(spark, licenses)), F.col("whole") == F.col("digest"), "left")
    names = F.create_map(*(F.lit(x) for pair in t.names.items() for x in pair)) if t.names else F.lit(None).cast("map<string,string>")
    hits = F.concat(F.transform("units", lambda d: F.split(F.element_at(names, d), r"\|")),
                    F.when(F.col("digest").isNotNull(), F.array(F.array("license", "category")))
                    .otherwise(F.array().cast("array<array<string>>")))
    step = step.select("doc_id", hits.alias("hits"), F.col("digest").isNotNull().alias("is_license"))

    def joined(k: int) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h[k]))), ",")
    return step.select("doc_id", F.size("hits").cast("long").alias("n_units"), joined(0).alias("licenses"),
                       joined(1).alias("categories"), "is_license")
