from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalog.llm import licenses as L
from stratalog.llm.licence_texts import TEMPLATES

from .helpers import LONG, lower_ascii

BAGS = [re.findall("[a-z0-9]+", text.lower()) for _, _, text in TEMPLATES]
SPREAD = Counter(t for own in BAGS for t in set(own))


def idf(t):
    return math.log((1 + len(BAGS)) / (1 + SPREAD[t])) + 1


def cosine(a, b):
    a, b = Counter(a), Counter(b)
    norm = lambda bag: math.sqrt(sum((n * idf(t)) ** 2 for t, n in bag.items()))
    return sum(n * b[t] * idf(t) ** 2 for t, n in a.items()) / norm(a) / norm(b)


def stated(text, named, threshold=0.8):
    """(licence, basis) by the definition: each template is tried where most of its words fall on those of the text."""
    tag = re.search(L.TAG, text or "")
    if tag:
        return re.sub("[ \t]+", " ", tag[1]), "tag"
    if not any(h in (text or "").lower() for h in L.HINTS):
        return None
    words, found = re.findall("[a-z0-9]+", lower_ascii(text)), []
    where = {}
    for at, w in enumerate(words):
        where.setdefault(w, []).append(at)
    for (licence, kind, _), own in zip(TEMPLATES, BAGS, strict=True):
        votes = Counter(at - q for q, t in enumerate(own) if t not in L.COMMON for at in where.get(t, ()))
        if votes and (named or kind != "title"):
            start = max(min(votes, key=lambda s: (-votes[s], s)), 0)
            found.append((round(cosine(words[start : start + len(own)], own), 6), licence))
    best = max((f for f in found if f[0] >= threshold), default=None)
    return best and (best[1], "header")


def scan(rows):
    own, speaking = {}, {}
    for i, path, text in rows:
        named = path is not None and re.search(L.LICENCE_FILE, path) is not None
        own[i] = stated(text, named)
        if own[i] and named:
            d = path.rpartition("/")[0]
            speaking[d] = min(speaking.get(d, (path, own[i][0])), (path, own[i][0]))
    out = {}
    for i, path, _ in rows:
        if own[i]:
            out[i] = (*own[i], None)
            continue
        out[i] = (None, None, None)
        d = None if path is None else path.rpartition("/")[0]
        while d is not None:
            if d in speaking:
                out[i] = (speaking[d][1], "inherited", d)
                break
            d = d.rpartition("/")[0] if d else None
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, p string, text string, _words string, licence int")
    out = L.scan_licences(df, F.col("p")).collect()
    assert len(out) == len(rows)
    return {r["doc_id"]: (r["licence"], r["basis"], r["licence_dir"]) for r in out}


TEXT = {(licence, len(BAGS[i])): text for i, (licence, _, text) in enumerate(TEMPLATES)}
PROSE = "the sea was calm that day and nobody in the harbour had seen the boat leave before dawn so they waited on the stones " * 3


def wrapped(text, mark, width=60):
    """As a comment: short lines behind a mark."""
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(f"{mark} {line.strip()}")
            line = ""
        line += f" {word}"
    return "\n".join([*lines, f"{mark} {line.strip()}"])


APACHE_HEADER = next(t for n, k, t in TEMPLATES if n == "Apache-2.0" and len(t) > 300 and k == "notice")
MIT_FULL = max((t for n, k, t in TEMPLATES if n == "MIT"), key=len)
MIT_GRANT = next(t for n, k, t in TEMPLATES if n == "MIT" and t.startswith("Permission"))
BSD2, BSD3 = (max((t for n, _, t in TEMPLATES if n == name), key=len) for name in ("BSD-2-Clause", "BSD-3-Clause"))
GPL = {n: next(t for m, k, t in TEMPLATES if m == n and "free software" in t) for n in ("GPL-2.0-or-later", "GPL-3.0-or-later", "GPL-3.0-only", "LGPL-2.1-or-later", "AGPL-3.0-or-later")}
MPL = next(t for n, k, t in TEMPLATES if n == "MPL-2.0" and k == "notice")
KEYED = [
    ("MIT", MIT_GRANT.replace("\n", " ")), ("Apache-2.0", APACHE_HEADER.replace("\n", " ")), ("MIT", wrapped(MIT_FULL, " *")), ("Apache-2.0", wrapped(APACHE_HEADER, "#")),
    ("BSD-2-Clause", wrapped(BSD2, "//")), ("BSD-3-Clause", wrapped(BSD3, "//", 40)), ("MPL-2.0", wrapped(MPL, "#", 50)),
    *((n, wrapped(t, ";;")) for n, t in GPL.items()),
    ("MIT", "Licensed under the MIT license."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0", "Licensed under the Apache License,\nVersion 2.0."), ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"), ("BSD-2-Clause", "// SPDX-License-Identifier: BSD-2-Clause\n"), ("MIT OR Apache-2.0", "/* SPDX-License-Identifier: (MIT OR  Apache-2.0) */"),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0"), ("LicenseRef-own", "SPDX-License-Identifier: LicenseRef-own"),
    ("ISC", "Copyright (c) 2020 A. Nother\n\n" + next(t for n, _, t in TEMPLATES if n == "ISC")), ("Unlicense", next(t for n, _, t in TEMPLATES if n == "Unlicense")),
    (None, "We took out a licence for the dog and a permission slip for the children, then sold the house."), (None, "This program is compatible with the MIT License and others."), (None, PROSE),
]


def test_known_wordings(spark):
    """Alone, behind a copyright line, and within other text: the same licence each time, and none for prose."""
    rows = []
    for i, (_, text) in enumerate(KEYED):
        rows += [(3 * i, f"x{i}/a.py", text), (3 * i + 1, f"x{i}/b.py", f"Copyright (c) 2021 Some Person\n{text}\n\nimport os\n{PROSE}"), (3 * i + 2, f"x{i}/c.py", f"{PROSE}\n{text} {PROSE}")]
    got = result(spark, rows)
    for i, (licence, text) in enumerate(KEYED):
        assert [got[3 * i + k][0] for k in range(3)] == [licence] * 3, (licence, text[:60], [got[3 * i + k] for k in range(3)])
    assert got == scan(rows)


def test_edited_notices(spark):
    """A word left out, a name put in."""
    rows = [
        (1, None, APACHE_HEADER.replace("you may not use this file", "you may not use this work, the Harbour Project,")),
        (2, None, MIT_FULL.replace("free of charge, ", "").replace("THE AUTHORS OR COPYRIGHT HOLDERS", "THE HARBOUR PROJECT")),
        (3, None, GPL["GPL-3.0-or-later"].replace("This program", "Harbour")),
        (4, None, BSD3.replace("the copyright holder", "Harbour Ltd.")),
    ]
    got = result(spark, rows)
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["Apache-2.0", "MIT", "GPL-3.0-or-later", "BSD-3-Clause"] and got == scan(rows)


MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."


def test_directories(spark):
    rows = [
        (1, "a/b/c/x.py", "code code"), (2, "a/LICENSE", MIT), (3, "a/b/y.py", f"// {APACHE}\n" + PROSE),
        (4, "a/b/c/d/COPYING.txt", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"),
        (5, "a/b/c/d/e/z.py", ""), (6, "top.py", None), (7, None, "text"), (8, None, MIT), (9, "ab/x.py", "code"),
        (10, "q/one.txt", APACHE), (11, "q/two.txt", MIT), (12, "q/r/s.txt", LONG), (13, "z/UNLICENSE", "nothing of the kind"), (14, "z/w.txt", "the mit of it"), (15, "q/r/last.txt", LONG + "\n" + MIT),
        (16, "t/LICENSE", MIT), (17, "t/LICENCE-2", APACHE), (18, "t/u/v/w/x/y.py", "deep"), (19, "title/x.py", "MIT License Copyright (c)"), (20, "title/LICENSE.md", "MIT License\n\nCopyright (c) 2020"),
    ]
    got = result(spark, rows)
    assert got == scan(rows)
    assert got[1] == ("MIT", "inherited", "a") and got[5] == ("GPL-3.0-only", "inherited", "a/b/c/d") and got[9] == (None, None, None) and got[7] == (None, None, None) and got[15][0] == "MIT"
    assert got[12] == (None, None, None), "only licence files speak for their directory"
    assert got[18] == ("Apache-2.0", "inherited", "t") and got[19] == ("MIT", "inherited", "title")


def test_licence_file_at_the_top(spark):
    rows = [(1, "LICENSE", MIT), (2, "a/b/c.py", "x"), (3, "c.py", None), (4, "/abs/d.py", "x")]
    got = result(spark, rows)
    assert got == scan(rows) and got[2] == ("MIT", "inherited", "")


def test_a_long_text_full_of_terms(spark):
    """Very many words of the templates, but no notice; then the notice at the end."""
    noise = " ".join(["license software permission copyright warranty version"] * 4000)
    rows = [(1, None, noise), (2, None, noise + "\n" + MIT_FULL)]
    got = result(spark, rows)
    assert got == scan(rows) and got[2][0] == "MIT" and got[1][0] is None


@pytest.mark.parametrize("which", range(len(TEMPLATES)))
def test_every_template_is_its_own_nearest(which):
    licence, kind, text = TEMPLATES[which]
    best = stated(text, True)
    assert best and best[0] in {n for n, _, t in TEMPLATES if t == text or re.findall("[a-z0-9]+", t.lower()) == BAGS[which]}


def test_documents_match_brute_force(spark, sf):
    from stratalog.llm.queries import op7_licences

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op7_licences(spark, sf).collect()
    got = {r["doc_id"]: (r["licence"], r["basis"], r["licence_dir"]) for r in out}
    assert got == scan([(r["doc_id"], r["path"], docs[r["doc_id"]]) for r in out])
    assert any(b == "header" for _, b, _ in got.values())


def test_files_of_one_tree(spark):
    """Licence files at every depth of generated trees, against brute force."""
    rng, rows = random.Random(3), []
    for i in range(300):
        folder = "/".join(rng.choice("ab") for _ in range(rng.randrange(6)))
        name = rng.choice(["LICENSE", "COPYING.md", "x.py", "y.py", "notlicense.py", "sub.licence"])
        rows.append((i, f"{folder}/{name}" if folder else name, rng.choice([MIT, APACHE, "SPDX-License-Identifier: ISC", "code", "", None])))
    got = result(spark, rows)
    assert got == scan(rows) and sum(b == "inherited" for _, b, _ in got.values()) > 30


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id long, p string, text string")
    assert L.scan_licences(df, F.col("p")).count() == 0
    rows = [(1, "a/x", MIT), (1, "a/x", MIT), (1, "a/x", "other"), (None, "a/y", None), (2, "a/LICENSE", MIT), (2, "a/LICENSE", MIT)]
    twice = spark.createDataFrame(rows, "path long, p string, text string")
    out = L.scan_licences(twice, F.col("p"), id_col="path")
    assert out.columns == ["path", "path_", "licence", "basis", "licence_dir", "cosine"]
    assert sorted((r["path"] or 0, r["licence"], r["basis"]) for r in out.collect()) == [(0, "MIT", "inherited"), (1, "MIT", "header"), (1, "MIT", "header"), (1, "MIT", "inherited"), (2, "MIT", "header"), (2, "MIT", "header")]


def test_no_python_in_the_plan(spark, sf):
    from stratalog.llm.queries import op7_licences

    plan = op7_licences(spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))
