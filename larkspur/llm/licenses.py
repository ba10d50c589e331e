"""License scans: TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

Candidates are the lines of a text that hold a cue (license, copyright, ...), the paragraphs of several lines that
do, and the whole text of a license file. Equal candidates are scored once. A candidate and a template are sparse
vectors over terms, weighted by frequency times ln((1 + N) / (1 + df)) + 1, where N and df count all candidates of the
corpus, copies included, and the short notices. The best template of cosine ``least`` or more is a text's own license.

Next to the short notices stand further templates: titles, standard headers and full texts. They are scored with the
same weights but are not counted in N and df, so the scores of the short notices do not depend on them. An SPDX tag names
its licenses exactly (score 1). For headers, further candidates are the comment a file begins with, its paragraphs where
comment markers hide them, and windows of two lines or more around each line with a cue, without comment markers; like the
further templates, they do not count in N and df. A line that is a short notice word for word needs no windows.

A license file gives its license to its directory. A file without an own license takes that of the nearest
directory above it: paths are joined through their directories, each taken once, against the ancestors' licenses.

Everything is DataFrame operations. Candidates, terms and directories are grouped before they are joined, so a notice
or a directory that holds a third of all rows is one row in those joins; the joins back to files may be split by
skewed keys at run time.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.shared import materialize

RESERVED = "LicenseRef-all-rights-reserved"
#: Short notices of common licenses, by SPDX identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-0": "Released under the MIT No Attribution License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-2-Clause": "Use of this source code is governed by the BSD 2-Clause Simplified License.",
    "BSD-3-Clause": "Use of this source code is governed by the BSD 3-Clause New or Revised License.",
    "ISC": "Released under the ISC License.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, all copyright and related rights are waived under CC0 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    RESERVED: "All rights reserved.",
}
_FSF = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by "
    "the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
)
_FSF_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License version {1} as published by the Free Software Foundation."
_CC = "This work is licensed under a Creative Commons {0} 4.0 International License."
_GNU = {
    "GPL-1.0": ("", "1", "February 1989"),
    "GPL-2.0": ("", "2", "June 1991"),
    "GPL-3.0": ("", "3", "29 June 2007"),
    "LGPL-2.0": ("Library ", "2", "June 1991"),
    "LGPL-2.1": ("Lesser ", "2.1", "February 1999"),
    "LGPL-3.0": ("Lesser ", "3", "29 June 2007"),
    "AGPL-3.0": ("Affero ", "3", "19 November 2007"),
}
_CC_KINDS = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-ND-4.0": "Attribution-NoDerivatives"}
#: Titles and standard headers (paragraphs of their own). The full texts are in ``license_texts``.
HEADERS = [
    *((k, f"GNU {kind}General Public License Version {version}, {day}") for k, (kind, version, day) in _GNU.items()),
    *((k, _FSF.format(kind, version)) for k, (kind, version, _) in _GNU.items()),
    *((k, _FSF_ONLY.format(kind, version)) for k, (kind, version, _) in _GNU.items()),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Licensed under the MIT License. See the LICENSE file in the project root for full license information."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."),
    ("MIT-0", "MIT No Attribution"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
    ),
    (
        "Apache-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for "
        "additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 "
        '(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    ("CC0-1.0", "CC0 1.0 Universal"),
    *((k, _CC.format(kind)) for k, kind in _CC_KINDS.items()),
    *((k, f"Creative Commons {kind} 4.0 International Public License") for k, kind in _CC_KINDS.items()),
]
#: The least score at which a further template counts, where ``least`` is lower.
LEAST_FURTHER = 0.7
SPDX = r"(?i)spdx-license-identifier:[ \t]*([\w.+() \t-]+)"
CUE = r"(?i)licen[sc]e|copyright|all rights reserved|spdx|public domain|creative commons|cc0"
TERM = r"\p{L}+|[0-9]+(?:\.[0-9]+)*"
PARAGRAPH = r"\n[ \t\r]*\n"
LICENSE_FILE = r"(?i)^(un)?(licen[sc]e|copying|notice|copyright)s?([-._].*)?$"
#: The comment a text begins with, and the comment markers around a line.
COMMENT = r"^\s*(/\*(?:[^*]|\*(?!/))*+\*/|<!--(?:[^-]|-(?!->))*+-->|(?:[ \t]*+(?://|#|--|;|%)[^\n]*+\n?)++)"
MARKERS = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--)?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$"
#: Lines of the longest window: the longest short notice, wrapped at 30 characters.
WINDOW = 5
PLACES = 6


def terms_of(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def further_templates() -> list[tuple[str, str]]:
    """(license, template): titles, headers and full texts; several to a license."""
    texts = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return HEADERS + [(f.stem, f.read_text("utf-8")) for f in texts]


def spdx_names(licenses: list[str]) -> list[tuple[str, str]]:
    """(name in lower case, license) for the SPDX forms of the licenses."""
    return sorted({(f"{k}{end}".lower(), k) for k in licenses for end in ("", "+", "-only", "-or-later")})


def candidates(files: DataFrame, cue: str = CUE) -> DataFrame:
    """(path, is_license_file, unit, counted): candidate notices of files (path, text, is_license_file)."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(cue))
    paragraphs = F.filter(F.split("text", PARAGRAPH), lambda x: x.rlike(cue) & x.contains("\n"))
    whole = F.when(F.col("is_license_file"), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = F.array_distinct(F.concat(lines, paragraphs, whole))
    comment = F.regexp_replace(F.regexp_extract("text", COMMENT, 1), MARKERS, "")
    head = F.filter(F.concat(F.split(comment, PARAGRAPH), F.array(comment)), lambda x: x.rlike(cue))
    notices = [" ".join(re.findall(TERM.replace(r"\p{L}", r"[^\W\d_]"), t.lower())) for t in TEMPLATES.values()]
    lined = files.where(F.col("text").rlike(cue) | F.col("is_license_file")).withColumn("bare", F.split(F.regexp_replace("text", MARKERS, ""), "\n"))
    at = F.filter(F.sequence(F.lit(0), F.size("bare") - 1), lambda i: F.get("bare", i).rlike(cue) & ~F.concat_ws(" ", terms_of(F.get("bare", i))).isin(notices))
    spans = F.array(*(F.struct(F.lit(before).alias("before"), F.lit(n).alias("n")) for n in range(2, WINDOW + 1) for before in range(n)))

    def window(i: Column, span: Column) -> Column:
        begin = F.greatest(i - span["before"], F.lit(0))
        return F.array_join(F.slice("bare", begin + 1, i - span["before"] + span["n"] - begin), "\n")

    windows = F.flatten(F.transform("at", lambda i: F.transform(spans, lambda span: window(i, span))))
    some = lined.select("path", "is_license_file", "bare", units.alias("units"), head.alias("head"), at.alias("at"))
    some = some.select("path", "is_license_file", "units", F.array_distinct(F.concat("head", windows)).alias("more"))

    def marked(found: Column | str, counted: bool) -> Column:
        return F.transform(found, lambda x: F.struct(x.alias("unit"), F.lit(counted).alias("counted")))

    return some.select("path", "is_license_file", F.inline(F.concat(marked("units", True), marked(F.array_except("more", "units"), False))))


def score_units(units: DataFrame, templates: DataFrame, least: float) -> DataFrame:
    """(mark, license, score) of the best template for each unit (mark, unit, n) that reaches ``least``.

    templates: (no, license, template, counted). Ties go to the smaller license id; scores are rounded to six places first.
    """
    own = units.select("mark", "n", F.explode(terms_of("unit")).alias("term")).groupBy("mark", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    other = templates.select("no", "license", "counted", F.explode(terms_of("template")).alias("term")).groupBy("no", "license", "counted", "term").agg(F.count("*").alias("tf"))
    total = (units.agg(F.sum("n")).first()[0] or 0) + templates.where("counted").count()
    df = own.select("term", "n").union(other.select("term", F.col("counted").cast("long"))).groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.select("term", (F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    unit = own.join(idf, "term").select("mark", "term", (F.col("tf") * F.col("idf")).alias("w"))
    template = other.join(idf, "term").select("no", "term", (F.col("tf") * F.col("idf")).alias("v"))
    unit_norm = unit.groupBy("mark").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("wn"))
    template_norm = template.groupBy("no").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("vn"))
    dot = unit.join(template, "term").groupBy("mark", "no").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    score = F.round(F.col("dot") / (F.col("wn") * F.col("vn")), PLACES)
    named = template_norm.join(templates.select("no", "license", "counted"), "no")
    scored = dot.join(named, "no").join(unit_norm, "mark").select("mark", "license", score.alias("score"), "counted")
    scored = scored.where(F.col("counted") | (F.col("score") >= LEAST_FURTHER)).withColumn("further", ~F.col("counted")).drop("counted")
    names = spdx_names([r[0] for r in templates.select("license").distinct().collect()])
    tags = units.where(F.col("unit").rlike(SPDX)).select("mark", F.explode(F.regexp_extract_all("unit", F.lit(SPDX), F.lit(1))).alias("tag"))
    tags = tags.select("mark", F.explode(F.split(F.lower("tag"), r"[\s()]+")).alias("name")).join(units.sparkSession.createDataFrame(names, "name string, license string"), "name")
    scored = scored.union(tags.select("mark", "license", F.lit(1.0), F.lit(True)).distinct())
    best = scored.where(F.col("score") >= least).groupBy("mark").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "further")).alias("b"))
    return best.select("mark", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), F.col("b.further").alias("further"))


def scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text", is_license_file: Column | None = None, templates: dict[str, str] | None = None, least: float = 0.7) -> DataFrame:
    """(path, license, score, origin, license_path) for every row of ``files``.

    ``origin`` is ``own`` (a notice of the file; ``license_path`` is its path), ``inherited`` (the nearest directory at or
    above the file's that a license file covers; ``license_path`` names that file) or null where there is neither.
    ``templates`` replaces the whole shelf by short notices. ``is_license_file`` says which rows are license files (by default by name). Of several in a directory the one of
    the highest score counts, then the least path. Null or empty text has no notice; a null path has no directory; ties
    between templates go to the smaller id; repeated paths are one file with the notices of all its rows, and
    each row of it gets the same result; an empty table gives no rows. Very long texts are searched whole, and every line with a cue
    counts. Other columns are ignored.
    """
    spark: SparkSession = files.sparkSession
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    known = F.coalesce(is_license_file if is_license_file is not None else name.rlike(LICENSE_FILE), F.lit(False))
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"), known.alias("is_license_file"))
    notices = [(*x, True) for x in sorted((templates or TEMPLATES).items())] + [(*x, False) for x in ([] if templates else further_templates())]
    shelf = spark.createDataFrame([(i, *x) for i, x in enumerate(notices)], "no int, license string, template string, counted boolean")

    # the one pass over the texts; all that follows reads candidates or paths
    found = materialize(candidates(rows).select("path", "is_license_file", F.md5("unit").alias("mark"), "unit", "counted"), "license-candidates")
    units = found.groupBy("mark").agg(F.first("unit").alias("unit"), F.count_if("counted").alias("n"))
    scored = materialize(score_units(units, shelf, least), "license-units")
    best = found.select("path", "is_license_file", "mark").join(scored, "mark").groupBy("path")
    one = F.struct((-F.col("score")).alias("s"), "license")
    # texts and headers of licenses hold that line themselves
    granted = F.when(F.bool_or("further"), F.min(F.when(F.col("license") != RESERVED, one)))
    best = best.agg(F.coalesce(granted, F.min(one)).alias("b"), F.bool_or("is_license_file").alias("is_license_file"))
    own = materialize(best.select("path", "is_license_file", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")), "license-own")

    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), F.lit(""))
    notices = own.where("is_license_file and path is not null").select(folder.alias("dir"), "path", "license", "score")
    covers = notices.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("c"))
    dirs = rows.select(folder.alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/")
    # the directory itself, those above it, and the top ("")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    steps = dirs.select("dir", F.posexplode(above).alias("depth", "up"))
    nearest = steps.join(covers.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("c", "depth").alias("c"))
    nearest = materialize(nearest.select("dir", (-F.col("c.s")).alias("up_score"), F.col("c.path").alias("up_path"), F.col("c.license").alias("up_license")), "license-dirs")

    joined = rows.select("path", folder.alias("dir")).join(own.drop("is_license_file"), "path", "left").join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return joined.select(
        F.col("path").alias(path_col),
        F.coalesce("license", "up_license").alias("license"),
        F.when(mine, F.col("score")).otherwise(F.col("up_score")).alias("score"),
        F.when(mine, "own").when(F.col("up_license").isNotNull(), "inherited").alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("up_path")).alias("license_path"),
    )
