"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Scan: templates are notices (up to ``NOTICE`` words) and whole licence texts. What is compared with them are spans of a
file: its lines and their sentences; the runs of adjacent lines and sentences of a paragraph (notices are wrapped;
comment marks are no words, and a line without a word ends a paragraph) of up to ``RUN`` times the words of the
longest notice; whole paragraphs; the runs of adjacent paragraphs that begin and end with a telling word's paragraph,
of up to twice the words of the longest template; and a licence file as a whole. Each span becomes a sparse TF-IDF vector over the templates' words and
word pairs. It is named by the template with the highest cosine of at least ``threshold``, unless a template of another
licence comes within ``MARGIN`` of it. A file takes the name of its span with the highest cosine; an opening
that several licences share counts only where nothing else is found. SPDX tags are spans too: each identifier of a tag's expression
is a vector of its own, compared with those of the known identifiers (at least ``TAG``, so that an identifier that only resembles one names
nothing); an expression gives all the licences that it names, joined by its operator.

A line, paragraph or run is only scored if it has one of the telling words, without which no vector reaches the
threshold: what is left of a template's vector without its telling words is too short. Runs are only scored if some
template's vector, cut down to the terms that they have, is long enough. Both are exact, so nothing that would match is passed over.

Inheritance: licence files (by name) give their directory's licence. Each directory that holds files is
joined to its ancestors on the path, itself included, and takes the licence of the nearest one that
has any. Files without a header of their own take their directory's. Paths are joined once a
directory, not once a file, and directories with very many files are dealt out over salts.

Null or empty text matches nothing. Ties of cosines between spans go to the licence that is first by name. Several
licence files in one directory: the highest cosine, then the first by licence. A null path stands for
a file at the root. Repeated rows each get a row. Whole texts are scanned, however long. Columns of any name pass through ``scan``, but for
``license``, ``license_score`` and those that begin with ``__sm_``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import cached_property
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, add_columns, checkpoint, heavy_keys, salted_join, texts_of

THRESHOLD, MARGIN, RUN, NOTICE, TAG = 0.7, 0.02, 4, 80, 0.97
_WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?").findall
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
_LINE = re.compile(r"\r\n?|\n")
#: Comment marks that are made of letters; all others are no words.
_MARK = re.compile(r"\s*(?:rem|dnl)\b")
_SPDX = re.compile(r"spdx-license-identifier:([^\r\n]*)").findall
_IDENTIFIER = re.compile(r"[a-z0-9][a-z0-9.+\-]*").findall
_TAGGED = "SPDX-License-Identifier: {}"
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice|unlicense)(?:[.\-][^/]*)?$"

#: Words that tell nothing of a licence by themselves.
COMMON = frozenset("a all an and any are as at be by can either for form free from in into is it later may met more new not of on or other person public software that the them these this to under use v version with work works you your".split())

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_SHORT = "Licensed under the GNU {}General Public License, version {}."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_1_2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
_MIT_END = (
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
_APACHE_END = (
    " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
#: Licence notices, titles and texts, by SPDX name.
TEMPLATES = (
    ("AGPL-3.0", _GNU_SHORT.format("Affero ", "3")),
    ("AGPL-3.0", _GNU.format("Affero ", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_END),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD}: {_BSD_1_2} {_BSD_END}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{_BSD}: {_BSD_1_2} {_BSD_3} {_BSD_END}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("", "2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_END}"),
    ("LGPL-2.1", _GNU_SHORT.format("Lesser ", "2.1")),
    ("LGPL-2.1", _GNU.format("Lesser ", "2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", _GNU_SHORT.format("Lesser ", "3")),
    ("LGPL-3.0", _GNU.format("Lesser ", "3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_END),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Openings that several licences share; that of the BSD texts alone counts as the one that asks more.
OPENINGS = (("BSD-3-Clause", _BSD),)


def terms(words: Iterable[str]) -> list[str]:
    """Words and pairs of words, but those of common words only."""
    words = list(words)
    return [*(w for w in words if w not in COMMON), *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if not (a in COMMON and b in COMMON))]


def paragraphs(text: str) -> list[list[str]]:
    """The paragraphs as lists of lines; a line without a word, such as a bare comment mark, ends one."""
    out: list[list[str]] = [[]]
    for line in _LINE.split(text):
        if _WORDS(_MARK.sub("", line, count=1)):
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def pieces(lines: list[str]) -> list[list[str]]:
    """The words of a paragraph's lines and their sentences, in order."""
    return [w for line in lines for s in _SENTENCE.split(_MARK.sub("", line, count=1)) if (w := _WORDS(s))]


class Matcher:
    """Unit vectors of the templates as postings, and what a span needs to match one."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, openings: tuple[tuple[str, str], ...] = OPENINGS, threshold: float = THRESHOLD):
        self.threshold = threshold
        ordered = sorted(templates) + sorted(openings)
        self.names = [name for name, _ in ordered]
        self.own = len(templates)  # the rest are openings
        words = [_WORDS(text.lower()) for _, text in ordered]
        counts = [Counter(terms(w)) for w in words]
        frequency = Counter(t for c in counts for t in c)
        self.idf = {t: log((1 + len(counts)) / (1 + n)) + 1 for t, n in frequency.items()}
        #: of a term that no template has
        self.rare = log(1 + len(counts)) + 1
        #: term to (template, weight in its unit vector)
        self.postings: dict[str, list[tuple[int, float]]] = {t: [] for t in self.idf}
        for k, c in enumerate(counts):
            norm = sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            for t, n in c.items():
                self.postings[t].append((k, n * self.idf[t] / norm))
        self.words = frozenset(w for t in self.idf for w in t.split())
        self.notice = RUN * max(len(w) for w in words if len(w) <= NOTICE)
        self.whole = 2 * max(map(len, words))
        #: words; every span that matches has one of them
        self.telling: list[str] = []
        for k in range(len(ordered)):
            mass = {t: w * w for t, ps in self.postings.items() for j, w in ps if j == k}
            while sum(mass.values()) >= (threshold - 1e-9) ** 2:
                left = {w for t in mass for w in t.split()} - COMMON
                known = left & set(self.telling)
                weigh = lambda w: sum(m for t, m in mass.items() if w in t.split())  # noqa: E731, B023
                word = max(sorted(known or left), key=weigh)
                if word not in self.telling:
                    self.telling.append(word)
                mass = {t: m for t, m in mass.items() if word not in t.split()}

    def judge(self, products: dict[int, float], square: float) -> list[tuple[float, bool, str]]:
        """What a span's products with the templates and its squared length say: (cosine, whether an opening, name)."""
        if not square:
            return []
        best: dict[tuple[bool, str], float] = {}
        for k, p in products.items():
            key = k >= self.own, self.names[k]
            best[key] = max(best.get(key, 0.0), p)
        norm, out = sqrt(square), []
        for shared in (False, True):
            ranked = sorted(((-p / norm, name) for (s, name), p in best.items() if s == shared))
            if ranked and -ranked[0][0] >= self.threshold and (len(ranked) == 1 or ranked[1][0] - ranked[0][0] >= MARGIN):
                out.append((-ranked[0][0], shared, ranked[0][1]))
        return out

    def of(self, words: list[str]) -> list[tuple[float, bool, str]]:
        """What one span's words match."""
        products: dict[int, float] = {}
        square = 0.0
        for t, n in Counter(terms(words)).items():
            idf = self.idf.get(t, self.rare)
            square += (n * idf) ** 2
            for k, w in self.postings.get(t, ()):
                products[k] = products.get(k, 0.0) + n * idf * w
        return self.judge(products, square)

    def able(self, words: Iterable[str]) -> bool:
        """Whether some template's vector, cut down to the terms that the words have, is long enough."""
        mass: dict[int, float] = {}
        for t in set(terms(words)):
            for k, w in self.postings.get(t, ()):
                mass[k] = mass.get(k, 0.0) + w * w
        return max(mass.values(), default=0.0) >= (self.threshold - 1e-9) ** 2

    def runs(self, parts: list[list[str]], limit: int, ends: list[bool] | None = None) -> list[tuple[float, bool, str]]:
        """What the runs of two or more adjacent parts match, of up to ``limit`` words; ``ends`` says which parts may begin and end one."""
        out = []
        for a in range(len(parts)):
            if not ends[a] if ends else self.words.isdisjoint(parts[a]):  # without ends: a run is no worse without it
                continue
            if ends:
                near, b = [], a
                while b < len(parts) and len(near) + len(parts[b]) <= limit:
                    near += parts[b]
                    b += 1
                if not self.able(near):
                    continue
            products: dict[int, float] = {}
            counts: dict[str, int] = {}
            square, length, last = 0.0, 0, None
            for b in range(a, len(parts)):
                length += len(parts[b])
                if length > limit:
                    break
                for w in parts[b]:
                    for t in ([w] if w not in COMMON else []) + ([f"{last} {w}"] if last and not (last in COMMON and w in COMMON) else []):
                        n, idf = counts.get(t, 0), self.idf.get(t, self.rare)
                        counts[t] = n + 1
                        square += (2 * n + 1) * idf * idf
                        for k, x in self.postings.get(t, ()):
                            products[k] = products.get(k, 0.0) + idf * x
                    last = w
                if b > a and (not ends or ends[b]):
                    out += self.judge(products, square)
        return out

    def scan(self, text: str | None, whole: bool = False) -> tuple[str | None, float]:
        """The licence of a text and its cosine, or (None, 0); ``whole`` for a licence file."""
        if not text:
            return None, 0.0
        low = text.lower()
        tags = [h for expression in _SPDX(low) if (h := self.tagged(expression))]
        telling = [w for w in self.telling if w in low]
        if not telling:
            return self._best(tags)
        has = lambda x: any(w in x for w in telling)
        told = paragraphs(low)
        lines = {line for p in told for line in p if has(line)}
        lines |= {s for line in lines for s in _SENTENCE.split(line) if has(s)}
        hits = [h for line in sorted(lines) for h in self.of(_WORDS(line))]
        split = [pieces(p) for p in told]
        joined = [[w for x in p for w in x] for p in split]
        marked = [any(has(line) for line in p) for p in told]
        for one in {tuple(map(tuple, p)) for p, m in zip(split, marked, strict=True) if m and len(p) > 1}:
            words = [w for x in one for w in x]
            if self.able(words):
                hits += self.of(words)
                hits += self.runs(list(map(list, one)), self.notice)
        hits += self.runs(joined, self.whole, marked)
        if whole:
            hits += self.of([w for p in joined for w in p])
        return self._best(hits + tags)

    @staticmethod
    def _best(hits: list[tuple[float, bool, str]]) -> tuple[str | None, float]:
        score, _, name = min(hits, key=lambda h: (h[1], -h[0], h[2]), default=(0.0, False, None))
        return name, score

    @cached_property
    def tags(self) -> Matcher:
        """The known identifiers as tags."""
        return Matcher(tuple((name, _TAGGED.format(name)) for name in sorted(set(self.names))), (), TAG)

    def tagged(self, expression: str) -> tuple[float, bool, str] | None:
        """What a tag's expression names: all its known licences in order, and the least of their cosines."""
        found: dict[str, float] = {}
        parts, after_with = _IDENTIFIER(expression), False
        for part in parts:
            if part not in ("and", "or", "with") and not after_with:
                span = _WORDS(_TAGGED.format(re.sub(r"(?:-only|-or-later|\+)$", "", part)).lower())
                for score, _, name in self.tags.of(span):
                    found[name] = max(score, found.get(name, 0.0))
            after_with = part == "with"
        return (min(found.values()), False, f" {'OR' if 'or' in parts else 'AND'} ".join(sorted(found))) if found else None


def scan(files: DataFrame, text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """``files`` with the columns license and license_score."""
    marked = files.withColumn(f"{OWN}whole", F.coalesce(F.col(path_col).rlike(LICENSE_FILE), F.lit(False)))

    def compute():
        matcher = Matcher(threshold=threshold)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            got = [matcher.scan(t, w) for t, w in zip(texts_of(batch, text_col), texts_of(batch, f"{OWN}whole"), strict=True)]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

        return work

    return add_columns(marked, [T.StructField("license", T.StringType()), T.StructField("license_score", T.DoubleType())], compute).drop(f"{OWN}whole")


def directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """A directory and those above it, the root ('') last, as an array."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit(""))))


def inherit(scanned: DataFrame, id_col: str = "doc_id", path_col: str = "path") -> DataFrame:
    """(id, path, license, license_score, basis, from_directory); basis: header, inherited or none."""
    files = checkpoint(scanned.select(id_col, path_col, "license", "license_score").withColumn("dir", directory(F.col(path_col))))
    own = files.filter(F.col(path_col).rlike(LICENSE_FILE) & F.col("license").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("license_score")).alias("s"), F.col("license").alias("l"))).alias("best")).select(F.col("dir").alias("above"), F.col("best.l").alias("dir_license"))
    folders = checkpoint(files.groupBy("dir").agg(F.count(F.lit(1)).alias("n")))
    # a directory near the root is an ancestor of very many: those are dealt out as well
    climbed = folders.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("up", "above"))
    busy = climbed.groupBy("above").agg(F.count(F.lit(1)).alias("m"))
    steps = climbed.count()
    nearest = salted_join(climbed, own, "above", heavy_keys(busy, "above", "m", steps), F.col("dir"), "inner").groupBy("dir").agg(F.min_by(F.struct("above", "dir_license"), "up").alias("near")).select("dir", "near.above", "near.dir_license")
    joined = salted_join(files, nearest, "dir", heavy_keys(folders, "dir", "n", folders.agg(F.sum("n")).first()[0] or 0), F.concat_ws(",", F.col(id_col).cast("string"), F.col(path_col)))
    basis = F.when(F.col("license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return joined.select(id_col, path_col, F.coalesce("license", "dir_license").alias("license"), "license_score", basis.alias("basis"), F.when(basis == "inherited", F.col("above")).alias("from_directory"))


def path_of_document() -> Column:
    """A path for a document: folders of 1000 and of 50 by id under its source.

    The first document of each folder is the folder's LICENSE file.
    """
    i, top = F.col("doc_id"), F.coalesce(F.col("source"), F.lit("unknown"))
    large, small = F.floor(i / 1000).cast("string"), F.floor(F.pmod(i, F.lit(1000)) / 50).cast("string")
    folder = F.concat_ws("/", top, F.concat(F.lit("v"), large))
    inner = F.concat(folder, F.lit("/s"), small)
    return (
        F.when(i.isNull(), F.concat(top, F.lit("/unnamed.txt")))
        .when(F.pmod(i, F.lit(1000)) == 0, F.concat(folder, F.lit("/LICENSE")))
        .when(F.pmod(i, F.lit(50)) == 0, F.concat(inner, F.lit("/LICENSE")))
        .otherwise(F.concat(inner, F.lit("/doc"), i.cast("string"), F.lit(".txt")))
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """Licences of all documents under the paths of ``path_of_document``."""
    return inherit(scan(docs.select("doc_id", "text", path_of_document().alias("path"))).drop("text"))
