"""Licences of files, as DataFrame operations: own lines, headers and licence files by TF-IDF, the rest by directory.

Lines that mention licensing, the leading comment or paragraph of a file and the paragraphs of licence files are compared
with templates by the cosine of their sparse TF-IDF vectors. A template counts only for a text that names
its licence, version and kind, and a licence only if no other one comes near. SPDX identifiers are read as such. A file that is
a licence file speaks for its directory and all below; a file without a licence of its own inherits from the nearest ancestor
that has one.

Weights come from the templates alone, so what a text is found to be depends on that text, not on its corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize


class Template(NamedTuple):
    """A licence's phrase, header or text. ``names`` is a pattern that must occur, ``barred`` one that must not."""

    license: str
    text: str
    names: str
    barred: str = ""


# Fixed phrases: how files usually name their licence.
_LINES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License, version 2.0."),
    ("EUPL-1.2", "Licensed under the European Union Public License, version 1.2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

def _gnu(name: str, version: str) -> str:
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as "
            f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
            "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
            "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
            f"{name} for more details. You should have received a copy of the GNU {name} along with this program. If not, "
            "see https://www.gnu.org/licenses/.")


_LIABLE = ("IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
           "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
           "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
           "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
           "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. ")
_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
          "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
          "DISCLAIMED. ")
_GNU = [("GPL", "General Public License", {"2.0": "June 1991", "3.0": "29 June 2007"}),
        ("LGPL", "Lesser General Public License", {"2.1": "February 1999", "3.0": "29 June 2007"}),
        ("AGPL", "Affero General Public License", {"3.0": "19 November 2007"})]
_CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
       ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
       ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
# Headers, texts and titles, and licences near those above.
_BODIES = [
    *((f"{k}-{v}", text) for k, name, versions in _GNU for v, date in versions.items() for text in (
        _gnu(name, v.removesuffix(".0")), f"This work is licensed under the GNU {name}, version {v.removesuffix('.0')}.",
        f"GNU {name} Version {v.removesuffix('.0')}", f"GNU {name} Version {v.removesuffix('.0')}, {date}",
        f"GNU {name} Version {v.removesuffix('.0')} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy "
        "and distribute verbatim copies of this license document, but changing it is not allowed.")),
    *((f"CC-{k}-4.0", text) for k, name in _CC for text in (
        f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"Licensed under CC {k} 4.0.",
        f"Creative Commons {name} 4.0 International Public License")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
     "required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
     "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
     "language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
     "REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", _BSD + _AS_IS + _LIABLE), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
     "or promote products derived from this software without specific prior written permission. " + _AS_IS + _LIABLE),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
     "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
     "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
     "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
     "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
     "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
     "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
     "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]
# What a text must say, in small letters and without punctuation, to be of a licence; bodies of texts have own ones.
_NAMES = {
    "Apache": r"\bapache\b", "BSD": r"\bbsd\b", "CC0": r"\bcc0\b|\bcc zero\b", "CC": r"\bcreative commons\b|\bcc[ -]by\b",
    "EPL": r"\beclipse public\b|\bepl\b", "EUPL": r"\beuropean union public\b|\beupl\b",
    "GPL": r"\bgnu general public\b|\bgpl", "LGPL": r"\bgnu (?:lesser|library) general public\b|\blgpl",
    "AGPL": r"\bgnu affero\b|\bagpl", "ISC": r"\bisc\b", "MIT": r"\bmit\b", "MPL": r"\bmozilla\b|\bmpl\b",
    "Unlicense": r"\bunlicense\b|\bunencumbered software\b"}
_BODY_NAMES = [
    ("BSD-2-Clause", "Redistribution", "redistribution and use", "neither the name"),
    ("BSD-3-Clause", "Redistribution", "redistribution and use .*neither the name", ""),
    ("BSD-2-Clause", "BSD 2", "2-clause|simplified bsd", ""), ("BSD-3-Clause", "BSD 3", "3-clause|new bsd|revised bsd", ""),
    ("BSD-3-Clause", "", r"\bbsd\b", "[24]-clause|simplified bsd"), ("MIT", "Permission", "permission is hereby granted", ""),
    ("ISC", "Permission", "permission to use", "")]


def template(license: str, text: str) -> Template:
    for name, start, names, barred in _BODY_NAMES:
        if license == name and text.startswith(start):
            return Template(license, text, names, barred)
    return Template(license, text, _NAMES[license if license in _NAMES else license.split("-")[0]])


TEMPLATES = [template(*t) for t in dict.fromkeys(_LINES + _BODIES)]
MENTION = "(?i)licen[cs]"
GRANT = (r"(?i)licen[cs]|permission\W+is\W+hereby|redistribution\W+and\W+use|permission\W+to\W+use|"
         r"free\W+and\W+unencumbered|\bcc0\b|creative\W+commons")
SPDX = (r"(?i)SPDX-License-Identifier:\s*([(]*[a-z0-9][a-z0-9.+-]*[)]*(?:[ \t]+(?:AND|OR|WITH)[ \t]+"
        r"[(]*[a-z0-9][a-z0-9.+-]*[)]*)*)")
#: What one identifier says beside the licence.
LATER = "^([^ ]+?)(?:-only|-or-later|[+])$"
NEGATED = r"\b(?:not|never|no longer|isn t|aren t) (?:[a-z]+ ){0,2}(?:licen[cs]ed|released|governed|covered|available)\b"
#: How lines of leading comments begin.
COMMENT = r"^\s*(?:$|#|//|/\*|\*|--|;|%|<!--)"
VERSION = (r"(?:version |v |gpl-?v?|(?:by|nc|sa|nd|attribution|noncommercial|sharealike|noderivatives|apache|mpl|epl|eupl|cc0)[ -])"
           r"([0-9](?:[.][0-9])?)")
#: Kinds of licences within a family, all of which a text must have like the licence.
KINDS = {"GNU": {"affero": "affero|agpl", "lesser": "lesser|library|lgpl"},
         "CC": {"nc": "noncommercial|nc", "sa": "sharealike|sa", "nd": "noderivatives|nd"}}
WORD = "[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"
NAMES = r"(?i)^(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
PARAGRAPH = r"(?:\r?\n|\r)[ \t]*(?:\r?\n|\r)"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def kind_pattern(kind: str) -> str:
    return rf"\b(?:{kind})(?:v?[0-9.]+)?\b"


def demands(license: str) -> tuple[list[str], list[tuple[str, bool]]]:
    """The versions that a text of a licence must name, and patterns that it must have or not."""
    said = license.lower()
    versions = [re.sub("[.]0$", "", v) for v in re.findall("-([0-9.]+)$", said)]
    family = "GNU" if "gpl" in said else "CC" if said.startswith("cc-") else None
    return versions, [(kind_pattern(k), bool(re.search(kind_pattern(k), said)))
                                   for k in KINDS.get(family, {}).values()]


def weights(templates: list[Template]) -> tuple[dict[str, float], float]:
    """ln(N / n) + 1 of each term in n of the N templates, and that of a term in none, which counts as in one."""
    number = Counter(w for t in templates for w in set(words_of(t.text)))
    return {w: math.log(len(templates) / n) + 1 for w, n in number.items()}, math.log(len(templates)) + 1


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))


def _patterns(templates: list[Template]) -> list[str]:
    """All patterns that templates ask for or bar, each once."""
    return sorted({p for t in templates for p in (t.names, t.barred, *(k for k, _ in demands(t.license)[1])) if p})


def _admitted(templates: list[Template]) -> Column:
    """Numbers of the templates whose demands a text meets that names the versions ``vs`` and has the patterns ``flags``."""
    at = {p: i for i, p in enumerate(_patterns(templates))}

    def rule(i: int, t: Template) -> Column:
        versions, kinds = demands(t.license)
        have = [at[t.names], *(at[p] for p, has in kinds if has)]
        lack = ([at[t.barred]] if t.barred else []) + [at[p] for p, has in kinds if not has]
        constant = (lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>"))
        return F.struct(F.lit(i).alias("id"), constant(have, "int").alias("have"), constant(lack, "int").alias("lack"),
                        constant(versions, "string").alias("versions"))

    def meets(r: Column) -> Column:
        return (F.forall(r["have"], lambda k: F.get("flags", k)) & ~F.exists(r["lack"], lambda k: F.get("flags", k))
                & (F.size(F.array_except(r["versions"], F.col("vs"))) == 0))

    return F.filter(F.array(*(rule(i, t) for i, t in enumerate(templates))), meets)["id"]


def nearest(texts: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = 0.6, margin: float = 0.02) -> DataFrame:
    """``key, license, cosine``: what each text of ``key, text`` is, where it is one licence.

    That is the licence of the nearest template that admits the text, from a cosine of ``threshold`` on and if no template of another
    licence is as near or less than ``margin`` farther. Equal keys must have equal texts. Null and empty texts give no row.
    """
    spark = texts.sparkSession
    idf, unseen = weights(templates)
    vectors: dict[str, list[tuple[int, float]]] = {}
    for i, t in enumerate(templates):
        tf = Counter(words_of(t.text))
        size = math.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items()))
        for w, n in tf.items():
            vectors.setdefault(w, []).append((i, n * idf[w] / size))
    # The size of this table is that of the templates.
    model = F.broadcast(spark.createDataFrame(
        [(w, idf[w], v) for w, v in vectors.items()], "term string, idf double, vector array<struct<id: int, v: double>>"))
    own = texts.groupBy("key").agg(F.max("text").alias("text")).select("key", _words("text").alias("words")).select(
        "key", "words", F.array_join("words", " ").alias("said"))
    own = own.select(
        "key", "words", F.array(*(F.col("said").rlike(p) for p in _patterns(templates))).alias("flags"), F.transform(
            F.regexp_extract_all("said", F.lit(VERSION), F.lit(1)), lambda v: F.regexp_replace(v, "[.]0$", "")).alias("vs"))
    # Written, so that no rule of a template looks for the patterns again.
    own = materialize(own, "texts").select("key", _admitted(templates).alias("fit"), "words").where(F.size("fit") > 0)
    terms = own.select("key", "fit", F.explode("words").alias("term")).groupBy("key", "fit", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    weighted = terms.join(model, "term", "left").select(
        "key", "fit", "vector", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("w"))
    parts = weighted.groupBy("key").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.flatten(F.collect_list(F.expr(
            "transform(filter(vector, x -> array_contains(fit, x.id)), x -> struct(x.id AS id, x.v * w AS part))"))).alias("parts"))
    dots = parts.select("key", "norm", F.inline("parts")).groupBy("key", "norm", "id").agg(F.sum("part").alias("dot"))
    name = F.get(F.array(*(F.lit(t.license) for t in templates)), F.col("id"))
    best = dots.groupBy("key", name.alias("license")).agg(F.max(F.round(F.col("dot") / F.col("norm"), 6)).alias("cosine"))
    return best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "license"))).alias("b")).select(
        "key", F.col("b")[0]["license"].alias("license"), (-F.col("b")[0]["far"]).alias("cosine"),
        (F.get("b", F.lit(1))["far"] - F.col("b")[0]["far"]).alias("gap")).where(
        (F.col("cosine") >= threshold) & (F.coalesce("gap", F.lit(1.0)) >= margin)).drop("gap")


def claims(files: DataFrame) -> DataFrame:
    """``path, words, rank, said``: what each of ``path, text`` says of its licence, in one pass over the texts.

    Rank 0 are lines that mention licensing without denying it, rank 1 the leading comment or else paragraph, and the whole text,
    all paragraphs and all pairs of neighbouring ones of files named as licence files. ``words`` counts those of the file.
    """
    rows = F.split("text", "\r?\n|\r")
    code = F.array_position(F.transform(rows, lambda r: r.rlike(COMMENT)), False)
    inside = F.regexp_extract("text", r"(?s)\A(?:#![^\n]*\n)?\s*(?:<[?]\w*\s*)?(?:/\*(.*?)\*/|<!--(.*?)-->|\"\"\"(.*?)\"\"\")", 0)
    leading = F.array_join(F.when(code == 0, rows).otherwise(F.slice(rows, 1, F.greatest(code - 1, F.lit(0)).cast("int"))), "\n")
    paragraphs = F.split("text", PARAGRAPH)
    first = F.element_at(F.split(F.ltrim("text"), PARAGRAPH, 2), 1)
    header = F.when(inside != "", inside).when(leading.rlike(r"\w"), leading).otherwise(first)
    pairs = F.zip_with(F.slice(paragraphs, 1, F.size(paragraphs) - 1), F.slice(paragraphs, 2, F.size(paragraphs)),
                       lambda a, b: F.concat_ws("\n", a, b))
    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(NAMES)
    denied = (lambda r: F.array_join(F.regexp_extract_all(F.lower(r), F.lit(WORD), F.lit(0)), " ").rlike(NEGATED))
    lines = F.filter(rows, lambda r: r.rlike(MENTION) & ~denied(r))
    blocks = F.when(named, F.concat(F.array(F.col("text")), paragraphs, pairs)).otherwise(F.array(header))
    found = files.where(F.col("path").isNotNull() & F.col("text").rlike(GRANT)).select(
        "path", F.size(_words("text")).alias("words"), F.explode(F.concat(
            F.transform(lines, lambda r: F.struct(F.lit(0).alias("rank"), r.alias("said"))),
            F.transform(F.array_distinct(F.filter(blocks, lambda b: b.rlike(GRANT))),
                        lambda b: F.struct(F.lit(1).alias("rank"), b.alias("said"))))).alias("c"))
    return found.select("path", "words", "c.rank", "c.said")


def licensed(files: DataFrame, path: str = "path", text: str = "text", threshold: float = 0.6, margin: float = 0.02,
             file_share: float = 0.5, templates: list[Template] = TEMPLATES) -> DataFrame:
    """``path, license, cosine, origin, directory`` for every file.

    A file's own licence is that of its line nearest to a template (equal ones by name of the licence), by the rules of ``nearest``;
    a line with an SPDX identifier says its licence as written, without ``-only``, ``-or-later`` or ``+`` if it is one, at a cosine
    of 1. Without such a line it is that of its leading comment or paragraph or, if it is named as a licence file, of
    its text or a paragraph, whichever is nearest. ``origin`` is then ``own``. A file is a licence file if it has a
    licence and is named as one or such lines make up ``file_share`` of its words; a directory's licence is that of its
    nearest-matching licence file, equal ones by name. Other files inherit from the nearest ancestor directory with a licence, their
    own directory first: ``origin`` is ``inherited`` and ``directory`` where from. Without any all are null.

    Null and empty texts have no licence of their own, a null path is in no directory and inherits nothing.
    Files of equal path are one file for their own licence, and each row gets a result row; an empty table gives none. A
    very long text is read by the words of its lines on licensing and of its header, that of a licence file as a whole.
    Other columns play no part.
    """
    body = files.select(F.col(f"`{path}`").cast("string").alias("path"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    said = claims(body).select(
        "path", "words", "rank", "said", F.sha2("said", 256).alias("key"), F.size(_words("said")).alias("n"),
        F.when(F.col("rank") == 0, F.nullif(F.regexp_extract("said", SPDX, 1), F.lit(""))).alias("spdx"))
    said = materialize(said, "claims")
    best = materialize(nearest(said.where("spdx IS NULL").select("key", F.col("said").alias("text")), templates, threshold, margin), "nearest")
    hits = said.join(best, "key", "left").select(
        "path", "words", "rank", "n", F.coalesce(F.regexp_replace("spdx", LATER, "$1"), "license").alias("license"),
        F.when(F.col("spdx").isNotNull(), F.lit(1.0)).otherwise(F.col("cosine")).alias("cosine")).where("license IS NOT NULL")
    own = materialize(hits.groupBy("path").agg(
        F.min(F.struct("rank", (-F.col("cosine")).alias("far"), "license")).alias("b"),
        F.coalesce(F.sum(F.when(F.col("rank") == 0, F.col("n"))), F.max("n")).alias("n"), F.max("words").alias("words")).select(
        "path", F.col("b.license").alias("license"), (-F.col("b.far")).alias("cosine"),
        (F.col("n") >= file_share * F.col("words")).alias("whole")), "own-licences")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    spoken = own.where(F.col("whole") | name.rlike(NAMES)).select(
        folder.alias("directory"), F.struct((-F.col("cosine")).alias("far"), "license").alias("b"))
    licences = materialize(spoken.groupBy("directory").agg(F.min("b").alias("b")).select(
        "directory", F.col("b.license").alias("license"), (-F.col("b.far")).alias("cosine")), "directory-licences")
    # Directories, not files, look for their ancestors, so a full directory counts once.
    parts = F.split("folder", "/", -1)
    ancestors = body.where("path IS NOT NULL").select(folder.alias("folder")).distinct().select(
        "folder", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))).alias("directory"))
    inherited = materialize(ancestors.join(licences, "directory").groupBy("folder").agg(F.max(F.struct(
        F.length("directory"), F.col("directory"), F.col("license"), F.col("cosine"))).alias("b")), "inherited")
    rows = body.select("path", folder.alias("folder")).join(own.drop("whole"), "path", "left").join(
        inherited, "folder", "left")
    mine = F.col("license").isNotNull()
    return rows.select(
        F.col("path").alias(path), F.coalesce("license", "b.license").alias("license"),
        F.when(mine, F.col("cosine")).otherwise(F.col("b.cosine")).alias("cosine"),
        F.when(mine, "own").when(F.col("b").isNotNull(), "inherited").alias("origin"),
        F.when(~mine, F.col("b.directory")).alias("directory"))
