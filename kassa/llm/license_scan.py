"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

A file's units are its lines, a leading comment block of several lines as a whole and, for a licence
file (LICENSE, COPYING and the like), its whole text as well.  Templates are sentences, standard headers
and full licence texts.  An SPDX tag decides, whatever else a file says.  Terms are weighted by inverse document frequency over all units of all files.  A unit's cosine to a
template is a sum over the terms they share, so it is a join on terms and a sum; the best template at
``THRESHOLD`` or above is the unit's licence, and a file's own licence is its best unit's.

A file without a licence of its own inherits from the nearest ancestor directory that has a licence
file: every directory is joined with its ancestors by path and the deepest match wins.  If no licence file there
is recognised, the licence is ``UNKNOWN``: what holds further up need not hold below it.

To reach the threshold a unit has to share one of a template's needed terms: the rest, taken from the
most frequent terms on, is too light even if all of it matched.  Only units that share such a term
are weighed; none above the threshold is lost.

Defined results: null and empty texts have no licence of their own; a null path has no directory and
inherits nothing; equal cosines go to the first template; several licence files in one directory:
the best cosine, then a fixed choice by path; an empty licence file is one that is not recognised; repeated
rows are judged each, by the same rules; an empty table has no rows; the caller's columns travel in the struct
``row``, whatever their names.
"""
from __future__ import annotations

import math
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.llm.common import Scratch

THRESHOLD = 0.6
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"
SALTS = 8
#: not a licence: holds where nothing else does, as licence texts often say it too
RESERVED = "all-rights-reserved"
#: the licence of a directory whose licence files say none that is known
UNKNOWN = "unknown"

#: Licences and the sentences that state them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (RESERVED, "All rights reserved"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("ISC", "Released under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
#: the notice that the GNU licences want at the head of a file; its first sentence stands alone too
GNU_NOTICE = ("This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as "
              "published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
              "later version.", " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
              "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for "
              "more details. You should have received a copy of the {name} along with this {what}. If not, see "
              "<https://www.gnu.org/licenses/>.")
for _licence, _what, _name, _version in (
        ("AGPL-3.0", "program", "GNU Affero General Public License", "3"),
        ("GPL-2.0", "program", "GNU General Public License", "2"),
        ("GPL-3.0", "program", "GNU General Public License", "3"),
        ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1"),
        ("LGPL-3.0", "library", "GNU Lesser General Public License", "3")):
    TEMPLATES += [(_licence, part.format(what=_what, name=_name, version=_version)) for part in (GNU_NOTICE[0], "".join(GNU_NOTICE))]
TEMPLATES += [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
#: full texts, by identifier
TEXTS = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in resources.files("kassa.llm").joinpath("licences").iterdir()}
# the Affero text is the GPL's with another name and a section 13 of its own
TEXTS["AGPL-3.0"] = (TEXTS["GPL-3.0"].replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC").replace(
    "GNU General Public", "GNU Affero General Public") + " Remote Network Interaction: users interacting with it remotely "
    "through a computer network must have an opportunity to receive the Corresponding Source from a network server")
TEMPLATES += sorted(TEXTS.items())

#: a tag that names the licence, or an expression of several, as it stands
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?: +(?:AND|OR|WITH) +[A-Za-z0-9.+()-]+)*)"
#: first lines of a comment block, its lines by marker, and blocks with an end
_COMMENT = r"^[ \t]*(?:#|//|--|;|%)"
_BLOCK = r"^(?:#![^\n]*\n)?\s*(/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\x22{3}[\s\S]*?\x22{3}|'{3}[\s\S]*?'{3})"


def terms(text):
    """Lower-case words (letters, digits, inner dots and hyphens) of a string column."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def directory(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).when(path.isNotNull(), F.lit(""))


def file_name(path):
    return F.regexp_extract(path, r"[^/]*$", 0)


def header(text):
    """A text's leading comment block if it has several lines, else null."""
    lines = F.split(text, "\n")
    end = F.array_position(F.transform(lines, lambda x: x.rlike(_COMMENT)), False).cast("int")
    marked = F.when(text.rlike(_COMMENT), F.array_join(F.slice(lines, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(lines))), "\n"))
    block = F.when(text.rlike(r"^(?:#![^\n]*\n)?\s*(?:/\*|<!--|\x22{3}|'{3})"), F.regexp_extract(text, _BLOCK, 1))
    either = F.coalesce(F.when(block != "", block), marked)
    return F.when(F.instr(either, "\n") > 0, either)


def units(files: DataFrame) -> DataFrame:
    """(file, unit, text): lines, leading comment blocks, whole texts of licence files; ``files``: file, path, text."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("unit", "line"))
    whole = files.where(file_name(F.col("path")).rlike(LICENCE_FILE)).select(
        "file", F.lit(-1).alias("unit"), F.col("text").alias("line"))
    heads = files.select("file", F.lit(-2).alias("unit"), header(F.col("text")).alias("line"))
    return lines.unionByName(whole).unionByName(heads).where(F.length("line") > 0)


def own_licences(scratch: Scratch, files: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(file, own, score) of the files with a licence of their own."""
    spark = files.sparkSession
    all_units = units(files)
    words = all_units.select("file", "unit", terms(F.col("line")).alias("words"))
    total = all_units.count()
    known = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, licence string, text string")
    known = known.select("template", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy(
        "template", "licence", "term").agg(F.count("*").alias("tf"))
    # a unit counts once per term; summed before the shuffle
    df = scratch.settle(words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(
        F.count("*").alias("df")), "df")

    def weight(tf, n):
        return tf * F.log(F.lit(total + 1.0) / (F.coalesce(n, F.lit(0)) + 1))

    # as many rows as the templates have terms
    weighed = known.join(df.withColumnRenamed("term", "dterm"), F.col("term") == F.col("dterm"), "left").select(
        "template", "licence", "term", F.coalesce("df", F.lit(0)).alias("df"), weight(F.col("tf"), F.col("df")).alias("w")).collect()
    often = {r["term"]: r["df"] for r in weighed}
    vectors: dict = {}
    for r in weighed:
        vectors.setdefault((r["template"], r["licence"]), {})[r["term"]] = r["w"]
    rows, needed = [], set()
    for (i, licence), v in sorted(vectors.items()):
        norm = math.sqrt(sum(w * w for w in v.values())) or 1.0
        rows += [(i, licence, t, w / norm) for t, w in v.items()]
        light = 0.0
        for t, w in sorted(v.items(), key=lambda x: (-often[x[0]], x)):
            if math.sqrt(light + (w / norm) ** 2) < threshold - 1e-9:
                light += (w / norm) ** 2
            elif often[t]:
                needed.add(t)
    vector = spark.createDataFrame(rows, "template int, licence string, vterm string, share double")
    some = words.where(F.exists("words", lambda w: w.isin(sorted(needed))) if needed else F.lit(False))
    counts = some.select("file", "unit", F.explode("words").alias("term")).groupBy("file", "unit", "term").agg(
        F.count("*").alias("tf"))
    counts = scratch.settle(counts, "terms")
    weights = counts.join(df.withColumnRenamed("term", "dterm"), F.col("term") == F.col("dterm")).select(
        "file", "unit", "term", weight(F.col("tf"), F.col("df")).alias("w"))
    weights = scratch.settle(weights, "weights")
    norms = weights.groupBy("file", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).select(
        F.col("file").alias("nf"), F.col("unit").alias("nu"), "norm")
    dots = weights.join(F.broadcast(vector), F.col("term") == F.col("vterm")).groupBy("file", "unit", "template", "licence").agg(
        F.sum(F.col("w") * F.col("share")).alias("dot"))
    scored = dots.join(norms, (F.col("file") == F.col("nf")) & (F.col("unit") == F.col("nu"))).withColumn(
        "score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
    best = scored.groupBy("file").agg(F.max_by(
        F.struct("licence", "score"), F.struct(F.col("licence") != RESERVED, "score", F.expr("-template"))).alias("best"))
    best = best.select("file", F.col("best.licence").alias("own"), F.col("best.score").alias("score"), F.lit(0).alias("tag"))
    tagged = files.select("file", F.regexp_extract("text", SPDX, 1).alias("own"), F.lit(1.0).alias("score"), F.lit(1).alias("tag"))
    either = best.unionByName(tagged.where(F.col("own") != "")).groupBy("file").agg(F.max_by(F.struct("own", "score"), "tag").alias("o"))
    return either.select("file", "o.own", "o.score")


def inherited(scratch: Scratch, files: DataFrame) -> DataFrame:
    """(directory, licence, from_directory) of directories with a licence file in themselves or above."""
    named = files.where(file_name(F.col("path")).rlike(LICENCE_FILE)).withColumns(
        {"own": F.coalesce("own", F.lit(UNKNOWN)), "score": F.coalesce("score", F.lit(-1.0))})
    stated = scratch.settle(named.groupBy(directory(F.col("path")).alias("at")).agg(
        F.max_by("own", F.struct("score", F.expr("-xxhash64(path)"))).alias("licence")), "stated")
    all_dirs = files.select(directory(F.col("path")).alias("dir")).where(F.col("dir").isNotNull()).distinct()
    parts = F.split("dir", "/")
    # a directory's ancestors, itself and the root ("") included: as many rows as the path is deep
    above = all_dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("ancestor")))).alias("a"))
    hit = above.join(stated, F.col("a.ancestor") == F.col("at"))
    return hit.groupBy("dir").agg(F.max_by(F.struct("licence", F.col("at").alias("from")), F.col("a.depth")).alias("best")).select(
        F.col("dir").alias("directory"), F.col("best.licence").alias("licence"), F.col("best.from").alias("from_directory"))


def scan(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Struct ``row`` (the caller's columns), ``own``, ``score``, ``licence``, ``from_directory``."""
    scratch = Scratch(files.sparkSession, "license-scan")
    keyed = files.select(F.struct(*[files[c] for c in files.columns]).alias("row"),
                         files[path].alias("path"), files[text].alias("text"))
    # equal path and text: the same file
    keyed = keyed.withColumn("file", F.md5(F.concat_ws("\x00", F.coalesce("path", F.lit("\x01")), F.coalesce("text", F.lit("")))))
    own = own_licences(scratch, keyed.select("file", "path", "text").where(F.col("text").isNotNull()), templates, threshold)
    own = scratch.settle(own.withColumnRenamed("file", "of"), "own")
    slim = keyed.select("row", "path", "file").join(own, F.col("file") == F.col("of"), "left")
    dirs = scratch.settle(inherited(scratch, slim.select("path", "own", "score")), "dirs")
    # salted: one directory may hold a third of all files
    dirs = dirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("licence", "above")
    slim = slim.withColumns({"dir": directory(F.col("path")), "s": F.pmod(F.xxhash64("file"), F.lit(SALTS)).cast("int")})
    out = slim.join(dirs, (F.col("dir") == F.col("directory")) & (F.col("s") == F.col("salt")), "left")
    return out.select("row", "own", "score", F.coalesce("own", "above").alias("licence"),
                      F.when(F.col("own").isNull(), F.col("from_directory")).alias("from_directory"))
