import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kassa.llm import license_scan as ls

FILES = [
    ("LICENSE", "Released under the MIT License."),
    ("a/x.py", "# code of some kind"),
    ("a/LICENSE.txt", "Licensed under the Apache License,\nVersion 2.0 (the whole file)"),
    ("a/b/c/y.py", "# Licensed under CC BY-NC 4.0.\nprint(1)"),
    ("a/b/c/z.py", "nothing here"),
    ("a/b/COPYING", "no licence that is known"),
    ("ab/w.py", None),
    ("top.py", ""),
    (None, "All rights reserved."),
    ("a/b/c/z.py", "nothing here"),
    ("q/r/licence", "This work is licensed under the GNU General Public License, version 3.\n" + "word " * 3000),
    ("q/r/s/t.py", "x"),
]


def terms(text):
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())


def brute(files):
    units = []
    for i, (path, text) in enumerate(files):
        if text is not None:
            lines = [x for x in text.split("\n") if x]
            if path and re.match(ls.LICENCE_FILE, path.rsplit("/", 1)[-1]) and text:
                lines.append(text)
            units += [(i, x) for x in lines]
    # the same file scanned twice is one file
    once, seen = [], set()
    for i, x in units:
        first = files.index(files[i])
        if first == i:
            once.append((i, x))
    df = Counter(t for _, x in once for t in set(terms(x)))
    idf = lambda t: math.log((len(units) + 1) / (df[t] + 1))
    own = {}
    for i, x in once:
        u = {t: n * idf(t) for t, n in Counter(terms(x)).items()}
        for k, (licence, template) in enumerate(ls.TEMPLATES):
            v = {t: n * idf(t) for t, n in Counter(terms(template)).items()}
            norm = math.sqrt(sum(w * w for w in u.values()) * sum(w * w for w in v.values()))
            score = round(sum(u[t] * v[t] for t in u if t in v) / norm, 9) if norm else 0
            if score >= ls.THRESHOLD:
                own[i] = max(own.get(i, (0,)), (score, -k, licence))
    return {files[i]: (licence, score) for i, (score, _, licence) in own.items()}


def test_own_and_inherited(spark):
    files = list(dict.fromkeys(FILES))
    rows = spark.createDataFrame(files, "path string, text string").withColumns({"own": F.lit(1), "score": F.lit(2)})
    got = {(r["row"]["path"], r["row"]["text"]): r for r in ls.scan(rows).collect()}
    want = brute(files)
    for f in files:
        assert got[f]["own"] == want.get(f, (None,))[0], f
        if f in want:
            assert got[f]["score"] == pytest.approx(want[f][1], abs=2e-9)
    licence = {p: (r["licence"], r["from_directory"]) for (p, _), r in got.items()}
    assert licence["LICENSE"] == ("MIT", None)
    assert licence["a/x.py"] == ("Apache-2.0", "a")
    # a licence file that is not recognised ends what its directory would inherit
    assert licence["a/b/c/z.py"] == ("unknown", "a/b")
    assert licence["a/b/c/y.py"] == ("CC-BY-NC-4.0", None)
    assert licence["a/b/COPYING"] == ("unknown", "a/b")
    assert licence["ab/w.py"] == ("MIT", "") and licence["top.py"] == ("MIT", "")
    assert licence[None] == ("all-rights-reserved", None)
    assert licence["q/r/s/t.py"] == ("GPL-3.0", "q/r")


def test_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame(FILES, "path string, text string")
    assert ls.scan(rows).count() == len(FILES)
    assert ls.scan(rows.limit(0)).count() == 0


def test_headers_texts_and_tags(spark):
    gpl = "# This work is licensed\n# under the GNU General\n# Public License, version 3\nx = 1"
    wrapped = ["".join(ls.GNU_NOTICE).format(what="program", name=n, version="3").replace(" GNU", "\n * GNU").replace(". ", ".\n * ")
               for n in ("GNU General Public License", "GNU Affero General Public License")]
    files = {
        "a.py": (gpl, "GPL-3.0"), "b.c": ("/* " + wrapped[0] + " */\nint x;", "GPL-3.0"),
        "c.c": ("/* " + wrapped[1] + " */\nint x;", "AGPL-3.0"), "d.rs": ("// SPDX-License-Identifier: MIT OR Apache-2.0\nfn x() {}", "MIT OR Apache-2.0"),
        "e.html": ("<!-- SPDX-License-Identifier: BSD-2-Clause -->", "BSD-2-Clause"), "f.py": ("# a\n# b\nplain = 1", None),
        **{f"{n}/LICENSE": (text, n) for n, text in ls.TEXTS.items()}}
    # plain lines, so that terms differ in how often they occur
    rows = [(p, t) for p, (t, _) in files.items()] + [(f"p{i}.txt", f"the word {i} of the file and {i % 7} is not to be") for i in range(400)]
    got = {r["row"]["path"]: r["own"] for r in ls.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: got[p] for p in files} == {p: licence for p, (_, licence) in files.items()}
    assert not any(v for p, v in got.items() if p not in files)


def test_ties_and_several_licence_files(spark):
    """Equal cosines go to the first template; of two licence files the better one counts, an unknown one last."""
    twice = [("B", "some words of a kind"), ("A", "some words of a kind"), ("C", "wholly other terms")]
    files = [("x/LICENSE", "some words of a kind"), ("x/LICENSE.other", "nothing that is known"), ("x/f", "plain"),
             ("y/COPYING", "wholly other terms and more"), ("y/LICENSE", "wholly other terms"), ("y/z/f", "plain"), ("w/LICENSE", ""), ("w/f", "plain")]
    files += [(f"p/{i}.txt", f"line {i} is {i % 5}") for i in range(60)]
    got = {r["row"]["path"]: (r["licence"], r["from_directory"]) for r in ls.scan(
        spark.createDataFrame(files, "path string, text string"), templates=twice).collect()}
    assert got["x/LICENSE"] == ("B", None) and got["x/f"] == ("B", "x") and got["x/LICENSE.other"] == ("B", "x")
    assert got["y/z/f"] == ("C", "y") and got["w/f"] == ("unknown", "w") and got["p/1.txt"] == (None, None)
