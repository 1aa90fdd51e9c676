"""Licence scan: which licence each file is under.

Texts are compared with templates by the cosine of sparse TF-IDF vectors,
weighted by how many files of the corpus hold a word.  What cannot reach the
similarity by the words it holds is left out before (``Weights``).  The templates are whole licence texts (``license_texts``), the standard
headers and one-line notices; what is compared with them is every line, every
paragraph, every block and the whole of the file, so a wrapped header and a
licence file are each met by one of their size.  SPDX tags are read, not
compared.  Files without a licence of their own inherit that of the nearest
directory above them that holds a licence file, by a join on directory paths.

All of it is DataFrame operations.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import stored

#: Whole licence texts, named by SPDX identifier; read on the driver.
TEXTS = Path(__file__).with_name("license_texts")
_GNU = (
    ("AGPL-3.0", "Affero General Public License", 3), ("GPL-1.0", "General Public License", 1), ("GPL-2.0", "General Public License", 2), ("GPL-3.0", "General Public License", 3),
    ("LGPL-2.0", "Library General Public License", 2), ("LGPL-2.1", "Lesser General Public License", 2.1), ("LGPL-3.0", "Lesser General Public License", 3),
)
_GNU_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_WITHOUT = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'


def _gnu(licence: str, version: float) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {licence} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


# SPDX identifiers and how files state them.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause New or Revised License."),
    ("CC-BY-4.0", "Licensed under Creative Commons Attribution CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Licensed under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", f"{_APACHE} {_APACHE_WITHOUT}"),
    ("Apache-2.0", _APACHE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    *((name, _gnu(licence, version) + rest) for name, licence, version in _GNU for rest in ("", _GNU_REST.format(licence))),
)
#: Names that SPDX tags may hold in another case; others are kept as written.
SPDX_NAMES = sorted({name for name, _ in TEMPLATES if name != "Proprietary"} | {file.stem for file in TEXTS.glob("*.txt")})
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([( ]*[a-z0-9][a-z0-9.+:-]*(?:[ \t)]+(?:and|or|with)[ \t(]+[a-z0-9][a-z0-9.+:-]*)*)"
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
TOKEN = r"[a-z]+|[0-9]+(?:[.][0-9]+)*"


def _tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _template_words() -> list[tuple[str, bool, Counter]]:
    """Licence, whether it is a whole text, and words, of each template."""
    whole = [(file.stem, True, file.read_text()) for file in sorted(TEXTS.glob("*.txt"))]
    every = [*((name, False, text) for name, text in TEMPLATES), *whole]
    return [(name, full, Counter(re.findall(TOKEN, text.lower()))) for name, full, text in every]


class Weights:
    """Weights of the templates' words, and what a unit must hold to reach one.

    idf is 1 + log((n + 1) / (df + 1)) over the n files of the corpus and the
    templates; words of no template weigh the mean of the others' idf.  All of it
    is as large as the templates are.

    The cosine of a unit and a template is at most the share, by norm, of the
    template's weights that stand at the unit's words.  So a unit reaches
    ``similarity`` only if it holds one of the heaviest words, those without which
    the rest has too small a norm (``telling``), and at least as many of the
    template's words as its heaviest need to make up that norm (``least``).
    Templates of like ``least`` are looked for together, which asks for less.

    Nor can it reach it if words of no template make up too much of its own norm:
    (1 + log tf)^2 is concave, so k words that stand m times in all weigh at most
    as if each stood m / k times (``alike``; words of like idf count together).
    """

    def __init__(self, templates: list[tuple[str, bool, Counter]], files: int, held: dict[str, int], similarity: float) -> None:
        df = Counter(held)
        for _, _, words in templates:
            df.update(words.keys())
        n = files + len(templates)
        self.idf = {w: 1 + log((n + 1) / (df[w] + 1)) for _, _, words in templates for w in words}
        self.other = sum(self.idf.values()) / len(self.idf)
        self.rows = []
        # Cosines are rounded to six digits.
        self.enough = enough = max(0.0, similarity - 1e-6) ** 2 * (1 - 1e-9)
        bands: dict[int, list[str]] = {}
        for w in sorted(self.idf):
            bands.setdefault(int(2 * self.idf[w]), []).append(w)
        self.bands = [(max(self.idf[w] for w in words), words) for _, words in sorted(bands.items())]
        classes: dict[int, tuple[list[int], set[str], set[str]]] = {}
        for number, (licence, full, words) in enumerate(templates):
            weight = {w: (1 + log(tf)) * self.idf[w] for w, tf in words.items()}
            norm = sum(v * v for v in weight.values())
            self.rows += [(number, licence, full, w, v / sqrt(norm)) for w, v in weight.items()]
            least, telling, rest, got = 0, set(), norm, 0.0
            for w in sorted(weight, key=lambda w: (-weight[w], w)):
                if got < enough * norm:
                    least, got = least + 1, got + weight[w] ** 2
                if rest >= enough * norm:
                    telling.add(w)
                rest -= weight[w] ** 2
            leasts, all_words, all_telling = classes.setdefault(least.bit_length(), ([], set(), set()))
            leasts.append(least)
            all_words.update(weight)
            all_telling.update(telling)
        self.classes = [(min(leasts), sorted(words), sorted(telling)) for _, (leasts, words, telling) in sorted(classes.items())]

    def may_reach(self, text: Column) -> Column:
        """False only where no template can be reached.  What holds of a part of
        a text holds of the text."""

        def enough(words: Column) -> Column:
            found = F.lit(False)
            for least, of, telling in self.classes:
                found = found | ((F.size(words) >= least) & F.exists(words, lambda x: x.isin(telling)) & (F.size(F.filter(words, lambda x: x.isin(of))) >= least))
            return found

        return F.exists(F.array(F.array_distinct(_tokens(text))), enough)


    def alike(self, text: Column) -> Column:
        """False only where no template can be reached.  Nothing follows for the
        parts of a text."""

        def most(idf: float, words: Column) -> Column:
            of = lambda m, k: F.when(m > 0, k * F.pow(1 + F.log(m / k), F.lit(2.0)) * idf * idf).otherwise(0.0)
            return F.element_at(F.transform(F.array(words), lambda x: of(F.size(x), F.size(F.array_distinct(x)))), 1)

        def enough(words: Column) -> Column:
            within = F.lit(0.0)
            for idf, of in self.bands:
                within = within + most(idf, F.filter(words, lambda x: x.isin(of)))
            other = F.size(F.array_distinct(F.filter(words, lambda x: ~x.isin(sorted(self.idf))))) * (self.other**2)
            return within >= (within + other) * self.enough

        return F.exists(F.array(_tokens(text)), enough)


def _weights(files: DataFrame, similarity: float) -> Weights:
    templates = _template_words()
    words = sorted({w for _, _, counts in templates for w in counts})
    held = files.select(F.explode(F.array_distinct(F.filter(_tokens("text"), lambda x: x.isin(words)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return Weights(templates, files.count(), {r["token"]: r["df"] for r in held.collect()}, similarity)


#: Where a comment begins or ends beside code, a blank line is put in.
_EDGES = ((r"(?m)^([ \t]*(?:#|//|/?\*|--|;|%)[^\n]*)\n(?=[ \t]*[^\s#/*;%-])", "$1\n\n"), (r"(?m)^([ \t]*[^\s#/*;%-][^\n]*)\n(?=[ \t]*(?:#|//|/\*|--|;|%))", "$1\n\n"))
WHOLE, BLOCK, PARAGRAPH, LINE = range(4)


def _units(text: Column, weights: Weights):
    """The file, its blocks (between blank lines), their paragraphs (between
    lines without a letter or digit) and lines, those that may reach a template:
    level, and the numbers of block, paragraph and line, or -1."""
    cued = lambda xs: F.filter(xs, lambda x: weights.may_reach(x["text"]))
    none = F.lit(-1)
    unit = lambda level, b, p, n, x: F.struct(F.lit(level).alias("level"), b.alias("b"), p.alias("p"), n.alias("l"), x.alias("text"))
    apart = text
    for pattern, by in _EDGES:
        apart = F.regexp_replace(apart, pattern, by)
    blocks = cued(F.transform(F.split(apart, r"\n[ \t\r\f]*\n"), lambda x, b: unit(BLOCK, b, none, none, x)))
    within = lambda level, xs, at, name: cued(F.flatten(F.transform(xs, lambda o: F.transform(F.split(o["text"], at), lambda x, i: unit(level, o["b"], i if name == "p" else o["p"], i if name == "l" else none, x)))))
    return F.array(unit(WHOLE, none, none, none, text)), blocks, lambda xs: within(PARAGRAPH, xs, r"\n[^\p{L}\p{N}\n]*\n", "p"), lambda xs: within(LINE, xs, r"\n", "l")


def _spdx(text: Column) -> Column:
    """The identifiers of a text's SPDX tags, without 'or later' and exceptions."""
    known = F.create_map(*(F.lit(x) for name in SPDX_NAMES for x in (name.lower(), name)))
    stated = F.array_join(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), " or ")
    names = F.regexp_extract_all(F.regexp_replace(stated, r"(?i)[ \t)]with[ \t(]+[a-z0-9.+:-]+", ""), F.lit(r"(?i)[a-z0-9][a-z0-9.+:-]*"), F.lit(0))
    names = F.transform(names, lambda x: F.regexp_replace(x, r"(?i)[.:-]+$|(?:-only|-or-later|\+)[.:-]*$", ""))
    names = F.transform(names, lambda x: F.coalesce(F.element_at(known, F.lower(x)), x))
    return F.array_distinct(F.filter(names, lambda x: ~F.lower(x).isin("", "and", "or", "none", "noassertion")))


def scan_licenses(files: DataFrame, similarity: float = 0.6) -> DataFrame:
    """One row per row of ``files`` (file_id, path, text): file_id, path,
    license (null if none), similarity, licenses (all that the file states,
    comma-joined), origin ('header', 'file', 'inherited' or null), from_path.

    A licence file is one named like one (LICENSE, COPYING, ...), one that as a
    whole is a licence text, or one of which every line states a licence.  Of
    several statements the likest one counts, then the first by name, and 'All
    rights reserved' only if there is no other; a statement less like a licence
    than the paragraph, block or file around it does not count.  Of several
    licence files in a directory, the likest, then the first by path.  Null
    texts are empty; a null path has no directory and inherits nothing.  Rows
    that repeat a file_id and path are one file whose statements are taken
    together, and each gets a row.  Other columns are not looked at.
    """
    spark = files.sparkSession
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME), F.lit(False))
    rows = files.select("file_id", F.col("path").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    weights = _weights(rows, similarity)
    told = rows.where(F.col("text").rlike(SPDX) | weights.may_reach(F.col("text"))).withColumns({"named": named, "spdx": _spdx(F.col("text")), "text": F.regexp_replace("text", r"(?i)SPDX-License-Identifier:[^\n]*", "")})
    whole, blocks, paragraphs, lines = _units(F.col("text"), weights)
    alike = lambda xs: F.filter(xs, lambda x: weights.alike(x["text"]))
    told = told.withColumn("blocks", blocks).withColumn("paragraphs", paragraphs(F.col("blocks"))).withColumn("cues", alike(lines(F.col("paragraphs"))))
    told = told.withColumn("only", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")) == F.size("cues"))
    read = F.transform("spdx", lambda x: F.struct(F.lit(LINE).alias("level"), F.lit(-1).alias("b"), F.lit(-1).alias("p"), F.lit(-1).alias("l"), F.lit("").alias("text"), x.alias("read")))
    compared = F.transform(F.concat(alike(F.concat(whole, "blocks", "paragraphs")), "cues"), lambda x: F.struct(x["level"].alias("level"), x["b"].alias("b"), x["p"].alias("p"), x["l"].alias("l"), x["text"].alias("text"), F.lit(None).cast("string").alias("read")))
    told = told.select("file_id", "path", "named", "only", F.explode(F.concat(compared, read)).alias("u")).select("file_id", "path", "named", "only", "u.*")
    every = stored(told.withColumn("tokens", _tokens("text")).drop("text").distinct(), "units")
    units = every.where("read is null")

    # Equal statements are compared once.
    texts = units.select("tokens").distinct().withColumn("statement", F.md5(F.concat_ws(" ", "tokens")))
    idf = F.broadcast(spark.createDataFrame(sorted(weights.idf.items()), "token string, idf double"))
    counts = texts.select("statement", F.explode("tokens").alias("token")).groupBy("statement", "token").agg(F.count("*").alias("tf"))
    left = counts.join(idf, "token", "left").withColumn("w", (F.log("tf") + 1) * F.coalesce("idf", F.lit(weights.other)))
    right = F.broadcast(spark.createDataFrame(weights.rows, "template int, license string, full boolean, token string, v double"))
    norms = left.groupBy("statement").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = left.join(right, "token").groupBy("statement", "template", "license", "full").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norms, "statement").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6))
    best = F.row_number().over(Window.partitionBy("statement").orderBy(F.desc("similarity"), "license"))
    matched = scored.where(F.col("similarity") >= similarity).withColumn("n", best).where("n = 1").select("statement", "license", "similarity", "full")
    stated = units.withColumn("statement", F.md5(F.concat_ws(" ", "tokens"))).join(matched, "statement", "left").drop("statement")
    read = every.where("read is not null").select("*", F.col("read").alias("license"), F.lit(1.0).alias("similarity"), F.lit(False).alias("full"))
    stated = stated.unionByName(read).drop("tokens")

    key = ["file_id", "path"]
    around = lambda level, *by: F.coalesce(F.max(F.when(F.col("level") == level, F.col("similarity"))).over(Window.partitionBy(*key, *by)), F.lit(0.0))
    stated = stated.withColumns({"w": around(WHOLE), "k": around(BLOCK, "b"), "g": around(PARAGRAPH, "b", "p")})
    above = F.greatest(*(F.when((F.col("level") > level) & F.col("read").isNull(), F.col(c)).otherwise(0.0) for level, c in ((WHOLE, "w"), (BLOCK, "k"), (PARAGRAPH, "g"))))
    is_told = F.col("license").isNotNull()
    counts = is_told & (F.col("similarity") >= above)
    line = F.when((F.col("level") == LINE) & F.col("read").isNull(), F.struct("b", "p", "l"))
    own = stated.groupBy(key).agg(
        F.min_by("license", F.when(counts, F.struct(F.col("license") == "Proprietary", -F.col("similarity"), F.col("license")))).alias("license"),
        F.min_by("similarity", F.when(counts, F.struct(F.col("license") == "Proprietary", -F.col("similarity"), F.col("license")))).alias("similarity"),
        F.array_join(F.array_sort(F.collect_set(F.when(counts, F.col("license")))), ",").alias("licenses"),
        # Nothing but licence lines: each line has been recognised.
        (
            F.max("named")
            # A licence text, and not a header before something else, which is likelier without it.
            | F.coalesce(F.max(F.when((F.col("level") == WHOLE) & F.col("full"), F.col("similarity"))) >= F.coalesce(F.max(F.when((F.col("level") == BLOCK) & F.col("full"), F.col("similarity"))), F.lit(0.0)), F.lit(False))
            | (F.max("only") & (F.count_distinct(line) > 0) & (F.count_distinct(line) == F.count_distinct(F.when(is_told, line))))
        ).alias("is_file"),
    )
    own = stored(own.where("license is not null"), "own")

    folder = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    order = Window.partitionBy("folder").orderBy(F.desc("similarity"), "path", "license")
    shared = own.where(F.col("is_file") & F.col("path").isNotNull()).withColumn("folder", folder).withColumn("n", F.row_number().over(order)).where("n = 1")
    shared = stored(shared.select("folder", F.col("license").alias("above"), F.col("similarity").alias("above_similarity"), F.col("path").alias("from_path")), "shared")

    # Folders, not files, look up their ancestors.
    parts = F.split("folder", "/")
    folders = rows.where("path is not null").select(folder.alias("folder")).distinct()
    ancestors = folders.withColumn("up", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("at"))))).select("folder", "up.depth", "up.at").where((F.col("depth") > 0) | (F.col("at") == "")).distinct()
    found = ancestors.join(shared.withColumnRenamed("folder", "at"), "at")
    nearest = found.groupBy("folder").agg(F.max_by(F.struct("above", "above_similarity", "from_path"), "depth").alias("near")).select("folder", "near.*")

    out = rows.select(*key, folder.alias("folder")).withColumn("_k", F.struct(F.coalesce(F.col("file_id").cast("string"), F.lit("\0")).alias("a"), F.coalesce("path", F.lit("\0")).alias("b")))
    own = own.select(F.struct(F.coalesce(F.col("file_id").cast("string"), F.lit("\0")).alias("a"), F.coalesce("path", F.lit("\0")).alias("b")).alias("_k"), "license", "similarity", "licenses", "is_file")
    out = out.join(own, "_k", "left").join(nearest, "folder", "left")
    return out.select(
        "file_id",
        "path",
        F.coalesce("license", "above").alias("license"),
        F.coalesce("similarity", "above_similarity").alias("similarity"),
        "licenses",
        F.when(F.col("license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("above").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("from_path")).alias("from_path"),
    )
