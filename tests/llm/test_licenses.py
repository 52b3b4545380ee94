"""Licences against a plain TF-IDF and a walk up the directories."""

import math
import re
from collections import Counter

from tracewell.llm import licenses as L

FILES = [
    ("a/LICENSE", "MIT\nReleased under the MIT License.\nmore words here and there"),
    ("a/b/c/x.py", "code"), ("a/b/y.py", "Licensed under CC BY-NC 4.0.\r\n" + "code " * 50), ("a/b/z.py", None),
    ("d/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    ("d/e/whole", "Licensed under the Apache License, Version 2.0."), ("d/e/f/g", ""), ("d/h", "text"), ("top", "text"),
    ("LICENCE.md", "a licence that nobody knows of at all"), (None, "Released under the MIT License."),
    ("q/LICENSE", "Licensed under CC BY-NC 4.0."), ("q/COPYING", "Released under the ISC License."), ("q/r", "x"), ("q/r", "x"),
    ("qq/r", "x"), ("/abs/LICENSE", "SPDX-License-Identifier: MIT"), ("/abs/dir/f", "")]


def words(text):
    return re.findall(L.WORD, text.lower())


def admits(t, said):
    versions, kinds = L.demands(t.license)
    told = {re.sub("[.]0$", "", v) for v in re.findall(L.VERSION, said)}
    return bool(re.search(t.names, said)) and not (t.barred and re.search(t.barred, said)) and set(versions) <= told and all(
        bool(re.search(p, said)) == has for p, has in kinds)


def nearest(text, threshold=0.6, margin=0.02):
    n = len(L.TEMPLATES)
    df = Counter(w for t in L.TEMPLATES for w in set(words(t.text)))
    vector = lambda x: {w: k * (math.log(n / df.get(w, 1)) + 1) for w, k in Counter(words(x)).items()}
    own, best = vector(text), {}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for t in L.TEMPLATES:
        if own and admits(t, " ".join(words(text))):
            v = vector(t.text)
            cosine = round(sum(own[w] * v[w] for w in own.keys() & v.keys()) / norm(own) / norm(v), 6)
            best[t.license] = max(best.get(t.license, 0), cosine)
    order = sorted((-c, name) for name, c in best.items())
    if order and -order[0][0] >= threshold and (len(order) == 1 or order[1][0] - order[0][0] >= margin):
        return order[0][1], -order[0][0]
    return None


def said(path, text):
    """Rank, text and SPDX expression of whatever a file says."""
    if not re.search(L.GRANT, text):
        return []
    rows = re.split("\r?\n|\r", text)
    out = [(0, r, (re.search(L.SPDX, r) or [None] * 2)[1]) for r in rows
           if re.search(L.MENTION, r) and not re.search(L.NEGATED, " ".join(words(r)))]
    parts = re.split(L.PARAGRAPH, text)
    if re.search(L.NAMES, path.rpartition("/")[2]):
        blocks = {text, *parts, *(f"{a}\n{b}" for a, b in zip(parts, parts[1:]))}
    else:
        blocks = {re.split(L.PARAGRAPH, text.lstrip())[0]}  # the texts here have no comments
    return out + [(1, x, None) for x in blocks if re.search(L.GRANT, x)]


def plain(files, share):
    hits, total = {}, {}
    for path, text in files:
        for rank, part, spdx in said(path, text or "") if path is not None else []:
            found = (re.sub(L.LATER, r"\1", spdx), 1.0) if spdx else nearest(part)
            if found:
                hits.setdefault(path, []).append((rank, -found[1], found[0], len(words(part))))
                total[path] = max(total.get(path, 0), len(words(text)))
    own, dirs = {}, {}
    for path, found in hits.items():
        rank, far, name, _ = min(found)
        own[path] = (far, name)
        lines = [n for r, *_, n in found if r == 0]
        if (sum(lines) if lines else max(n for *_, n in found)) >= share * total[path] or re.search(L.NAMES, path.rpartition("/")[2]):
            folder = path.rpartition("/")[0]
            dirs[folder] = min(dirs.get(folder, own[path]), own[path])
    out = []
    for path, _ in files:
        if path in own:
            out.append((path, own[path][1], -own[path][0], "own", None))
            continue
        at = path.rpartition("/")[0] if path is not None else None
        while at is not None and at not in dirs:
            at = at.rpartition("/")[0] if at else None
        out.append((path, dirs[at][1], -dirs[at][0], "inherited", at) if at is not None else (path, None, None, None, None))
    return sorted(out, key=repr)


def test_against_plain(spark):
    for share in (0.5, 0.1):
        df = spark.createDataFrame([(p, t, "x", 1, "k", 2) for p, t in FILES],
                                   "path string, text string, license string, directory int, key string, rank int")
        got = L.licensed(df, file_share=share)
        assert got.columns == ["path", "license", "cosine", "origin", "directory"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain(FILES, share)
    assert L.licensed(df.limit(0)).collect() == []


#: What lines say, and what they don't.
SAID = {
    "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    "SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "/* SPDX-License-Identifier: MIT OR Apache-2.0 */": "MIT OR Apache-2.0",
    "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception": "Apache-2.0 WITH LLVM-exception",
    "# SPDX-License-Identifier: (GPL-2.0-only OR MIT)": "(GPL-2.0-only OR MIT)", "SPDX-License-Identifier: LGPL-2.1+": "LGPL-2.1",
    "Released under the BSD License.": "BSD-3-Clause", "BSD 3-Clause License": "BSD-3-Clause", "BSD 2-Clause License": "BSD-2-Clause",
    "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under the Eclipse Public License, version 2.0": "EPL-2.0", "European Union Public License, version 1.2": "EUPL-1.2",
    "Eclipse Public License, version 1": None, "European Union Public License, version 3": None,
    "This is not released under the MIT License.": None, "governed by an Apache-style license": None,
    "This work is licensed under the General Electric License, version 3.": None, "Licensed under the Apache License": None,
    "It is no longer licensed under the MIT License.": None, "a driving license, version 2, of the public": None}


def test_lines(spark):
    df = spark.createDataFrame([(f"{i}.txt", "code\n" * 20 + line + "\ncode" * 20) for i, line in enumerate(SAID)], "path string, text string")
    got = {r.path: r.license for r in L.licensed(df, file_share=2.0).collect()}
    assert got == {f"{i}.txt": name for i, name in enumerate(SAID.values())}


def test_one_text_at_a_time(spark):
    """What a file is found to be depends on no other file."""
    all_of = {r.path: (r.license, r.cosine) for r in L.licensed(spark.createDataFrame(FILES, "path string, text string")).where("origin = 'own'").collect()}
    for path, text in [f for f in FILES if f[0] in all_of][:3]:
        row = L.licensed(spark.createDataFrame([(path, text)], "path string, text string")).first()
        assert (row.license, row.cosine) == all_of[path]


def test_very_long_texts(spark):
    long = "word " * 200_000
    df = spark.createDataFrame([
        ("a/LICENSE", "MIT License\n\n" + long), ("a/x", long + "\nReleased under the ISC License.\n" + long), ("a/y", "license " * 100_000),
        ("b/COPYING", (long[:5000] + "\n\n") * 100 + "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007")], "path string, text string")
    assert {r.path: r.license for r in L.licensed(df).collect()} == {"a/LICENSE": "MIT", "a/x": "ISC", "a/y": "MIT", "b/COPYING": "GPL-3.0"}


def test_headers_and_texts(spark):
    import textwrap

    body = lambda name, start: next(t.text for t in L.TEMPLATES if t.license == name and t.text.startswith(start))
    wrap = lambda text, by: "\n".join(by + row for row in textwrap.wrap(text, 70))
    code = "\n\n" + "x = call(y)\n" * 400
    gpl2, gpl3, agpl = (body(n, "This program") for n in ("GPL-2.0", "GPL-3.0", "AGPL-3.0"))
    bsd3, bsd2 = (body(n, "Redistribution") for n in ("BSD-3-Clause", "BSD-2-Clause"))
    files = [
        ("a/x.py", "#!/usr/bin/python\n# Copyright 2020 A. Person\n#\n" + wrap(gpl2, "# ") + code, "GPL-2.0"),
        ("a/y.c", "/* Copyright 2020 A. Person\n" + wrap(gpl3, " * ") + "\n */" + code, "GPL-3.0"),
        ("a/z.js", wrap(agpl, "// ") + code, "AGPL-3.0"),
        ("b/LICENSE", "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n" + wrap(bsd3, ""), "BSD-3-Clause"), ("b/c/d", "x", "BSD-3-Clause"),
        ("c/LICENSE", "Copyright (c) 2020, A. Person\n\n" + wrap(bsd2, ""), "BSD-2-Clause"),
        ("d/LICENSE.txt", "Copyright (c) 2020 A. Person\n\n" + wrap(body("MIT", "Permission"), ""), "MIT"),
        ("e/x", "code\nThis work is licensed under the GNU General Public License, version 2.\n", "GPL-2.0"),
        ("e/y", "code\nThis work is licensed under the GNU Affero General Public License, version 3.\n", "AGPL-3.0"),
        ("e/z", "code\nLicensed under CC BY-SA 4.0.\n", "CC-BY-SA-4.0"), ("f/x", "# This is no licence at all.\n" + code, None),
        ("g/COPYING", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.\n"
         "Everyone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n"
         + "The terms of the work and its copies. " * 300, "GPL-2.0")]
    got = L.licensed(spark.createDataFrame([f[:2] for f in files], "path string, text string"))
    assert {r.path: r.license for r in got.collect()} == {p: name for p, _, name in files}
