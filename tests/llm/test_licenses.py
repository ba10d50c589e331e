import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from larkspur.llm import licenses
from larkspur.llm.queries import op1_licenses, oracle_sql
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.01"
MIT, APACHE = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]


def test_equals_sql(spark):
    assert rows(op1_licenses(spark, SF).toPandas()) == rows(connect(SF).sql(oracle_sql()["op1_licenses"]).df())


def scan(spark, files, **kw):
    df = spark.createDataFrame([(*f, "clash", 1.0) for f in files], "path string, text string, license string, score double")
    return {r.path: r for r in licenses.scan(df, **kw).collect()}


def test_nearest_ancestor(spark):
    got = scan(
        spark,
        [
            ("LICENSE", MIT), ("a/LICENSE.txt", f"Some title\n{APACHE}\nmore text"), ("a/b/c/file", "text"), ("a/x", f"code\n{MIT}\ncode"),
            ("other/deep/down/f", None), ("top", ""), ("ab/f", "nothing"), (None, MIT), ("a/b/COPYING", "no notice here"),
        ],
    )
    assert (got["a/b/c/file"].license, got["a/b/c/file"].origin, got["a/b/c/file"].license_path) == ("Apache-2.0", "inherited", "a/LICENSE.txt")
    assert (got["a/x"].license, got["a/x"].origin, got["a/x"].license_path) == ("MIT", "own", "a/x")
    assert got["other/deep/down/f"].license_path == "LICENSE"
    assert got["top"].license == "MIT"
    assert got["ab/f"].license_path == "LICENSE"
    assert got["a/b/COPYING"].license == "Apache-2.0"
    assert got[None].license is None


def test_no_license_and_empty_table(spark):
    got = scan(spark, [("a/b", "plain"), ("c", "the license of this is a long story that has nothing to do with any known template at all, really")])
    assert {r.origin for r in got.values()} == {None}
    assert scan(spark, []) == {}


def test_ties_and_repeated_rows(spark):
    df = spark.createDataFrame([("d/LICENSE", MIT), ("d/LICENSE", MIT), ("d/COPYING", APACHE), ("d/f", "x"), ("d/f", "x")], "path string, text string")
    got = licenses.scan(df).collect()
    assert len(got) == 5
    assert {(r.license, r.license_path) for r in got if r.path == "d/f"} == {("Apache-2.0", "d/COPYING")}


def test_cosine_by_hand(spark):
    texts = [MIT, "Released under the MIT License, with one exception.", "Copyright 2020 someone. " + APACHE, "license " * 50]
    units = [t for t in texts]
    templates = licenses.TEMPLATES
    split = lambda t: Counter(re.findall(r"[^\W\d_]+|[0-9]+(?:\.[0-9]+)*", t.lower()))
    vectors = [split(t) for t in units] + [split(t) for t in templates.values()]
    df = Counter(w for v in vectors for w in v)
    idf = {w: math.log((1 + len(vectors)) / (1 + n)) + 1 for w, n in df.items()}

    def cosine(a, b):
        dot = sum(a[w] * b[w] * idf[w] ** 2 for w in a if w in b)
        return dot / math.sqrt(sum((n * idf[w]) ** 2 for w, n in a.items()) * sum((n * idf[w]) ** 2 for w, n in b.items()))

    got = scan(spark, [(f"f{i}", t) for i, t in enumerate(texts)], least=0.0)
    for i, t in enumerate(texts):
        want = max((round(cosine(split(t), split(x)), 6), [-ord(c) for c in k], k) for k, x in templates.items())
        assert abs(got[f"f{i}"].score - want[0]) < 2e-6
        assert got[f"f{i}"].license == want[2]


def test_native_plan(spark):
    df = spark.createDataFrame([("a/LICENSE", MIT)], "path string, text string")
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan
    assert df.select(F.size(licenses.terms_of("text"))).first()[0] == 5


GPL2_HEADER = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
MIT_BODY = """Copyright (c) 2019 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE.
"""


def test_texts_headers_and_tags(spark):
    texts = {f.stem: f.read_text() for f in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    commented = "/*\n" + "\n".join(f" * {x}".rstrip() for x in GPL2_HEADER.split("\n")) + "\n */\nint main;"
    hashed = "\n".join(f"# {x}".rstrip() for x in MIT_BODY.split("\n")) + "\nimport os\n"
    got = scan(
        spark,
        [
            *((f"{k}/LICENSE", "Some project, all of it\n\n" + t) for k, t in texts.items()),
            ("mit/LICENSE", MIT_BODY), ("agpl/COPYING", texts["GPL-3.0"].replace("GENERAL", "AFFERO GENERAL").replace("29 June", "19 November")),
            ("src/a.c", commented), ("src/b.py", hashed), ("src/c.py", "#!x\n# SPDX-License-Identifier: GPL-2.0-or-later WITH x\ny"),
            ("src/d.c", "// SPDX-License-Identifier: Apache-2.0\ny"), ("src/e.c", "// SPDX-License-Identifier: Zlib\ny"),
            ("src/f.js", "/* SPDX-License-Identifier: (ISC OR MIT) */\ny"), ("src/g", "We have a license to sing and the copyright of the song"),
        ],
    )
    for k in texts:
        assert (got[f"{k}/LICENSE"].license, got[f"{k}/LICENSE"].origin) == (k, "own")
    assert got["mit/LICENSE"].license == "MIT"
    assert got["agpl/COPYING"].license == "AGPL-3.0"
    want = {"a.c": "GPL-2.0", "b.py": "MIT", "c.py": "GPL-2.0", "d.c": "Apache-2.0", "e.c": None, "f.js": "ISC", "g": None}
    assert {k: got[f"src/{k}"].license for k in want} == want


def test_wrapped_notices(spark):
    got = scan(
        spark,
        [
            ("a", "This is a tool for people who sort\nthe mail of others by its color.\nThis work is licensed under the GNU General Public\nLicense, version 2.\nMore of it is told in the manual."),
            ("b.py", "# a tool for people\n# This Source Code Form is\n# subject to the terms of the\n# Mozilla Public License, v.\n# 2.0. And so on, as told in the long manual of this tool"),
            ("c.c", "x = 1;\n// Licensed under the Apache\n// License, Version 2.0.\ny = 2;"),
        ],
    )
    assert {k: (r.license, r.score) for k, r in got.items() if k != "b.py"} == {"a": ("GPL-2.0", 1.0), "c.c": ("Apache-2.0", 1.0)}
    assert got["b.py"].license == "MPL-2.0"
