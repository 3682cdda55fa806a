"""License scans, by DataFrame and SQL functions alone.

What tells most is taken first. Identifiers after SPDX-License-Identifier, and
passages like a license's own words: whole texts, comment blocks and paragraphs
of LEAST_TOKENS tokens or more with a cue, without copyright notices and
comment signs, are compared with the full texts in license_texts and with the
usual headers (terms weighed 1 + log tf). The texts of AGPL-3.0, CC-BY-4.0 and
CC-BY-NC-4.0 there are derived from those of GPL-3.0 and CC-BY-SA-4.0. Then
single lines are compared with statements, last with names of licenses.

Statements: passages that may be license headers (lines with a cue such as `license` or
`rights reserved`, and the whole of files named like licence files) are
compared with templates: sparse TF-IDF vectors, with the templates' document
frequencies, and their cosine. A file's license is that of its most similar
passage of MIN_COSINE or more, ties by name. A file is a licence file if it is
named like one or half of its tokens or more stand in matching passages; a
directory's license is that of its best licence file, ties by path. Files
without a license of their own take that of the nearest ancestor directory
that has one; the root is the directory '' above all paths.

Defined cases: a null or empty text has no license of its own; a null path is
a file in no directory; scan() has a row for each given row, and its column row
may be null or repeated, as files are told by path and text; very long texts are
scanned whole; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import written

MIN_COSINE = 0.7
# Usual statements of common licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This library is free software under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
)
#: Fewer tokens than this are a statement or a name, not a header or text.
LEAST_TOKENS = 20
_GNU = (
    "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
    "{comma} either version {version} of the License, or (at your option) any later version."
)
_GNU_REST = (
    " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR"
    " PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}."
)
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
_APACHE_REST = (
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
    ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)
_GNU_KINDS = (
    ("AGPL-3.0", "program", "Affero General Public License", "3"),
    ("GPL-2.0", "program", "General Public License", "2"),
    ("GPL-3.0", "program", "General Public License", "3"),
    ("LGPL-2.0", "library", "Library General Public License", "2"),
    ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", "Lesser General Public License", "3"),
)
# Usual headers.
HEADERS = (
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_REST),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *[
        (license, text.format(what=what, name=name, version=version, colon=":", comma=","))
        for license, what, name, version in _GNU_KINDS
        for text in (_GNU, _GNU + _GNU_REST)
    ],
)
# Names by which a line can tell a license.
NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License v3"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU General Public License v2"),
    ("GPL-3.0", "GNU General Public License v3"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License v2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License v3"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
)
SPDX = r"(?i)spdx-license-identifier:[ \t]*([^\n]*)"
COMMENT = r"#|//|/\*|\*|;|--|%|<!--"
NOTICE = r"(?im)^[^a-z0-9\n]*(?:portions )?copyright\b[^\n]*(?:\d{4}|\(c\)|©|<year>|regents)[^\n]*$"
CUE = r"licen[sc]e|copyright|rights reserved|spdx|public domain|redistribution"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
TOKEN = "[a-z0-9]+"
PASSAGE = ("row", "named", "n_tokens", "no", "length")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def template_weights(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(license, token, weight, idf, unseen): unit vectors of the templates, and idf for their tokens and for others."""
    given = spark.createDataFrame(list(templates), "license string, statement string")
    counts = given.select("license", F.explode(_tokens(F.col("statement"))).alias("token")).groupBy("license", "token").agg(F.count(F.lit(1)).alias("tf"))
    n = float(len(templates))
    idf = counts.groupBy("token").agg((F.log((1 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    weighed = counts.join(idf, "token").withColumn("raw", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("license").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighed.join(norms, "license").select("license", "token", (F.col("raw") / F.col("norm")).alias("weight"), "idf")


def unseen_idf(templates=TEMPLATES) -> Column:
    return F.log(F.lit(1.0 + len(templates))) + 1


def own_licenses(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Of (row, path, text): row, license, similarity, is_file for rows with a license of their own."""
    weights = template_weights(files.sparkSession, templates)
    text = F.col("text").cast("string")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.lower(x).rlike(CUE))
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    passages = (
        files.select("row", named.alias("named"), F.when(named, F.array(text)).otherwise(lines).alias("passages"), F.when(named | (F.size(lines) > 0), F.size(_tokens(text))).alias("n_tokens"))
        .where(F.size("passages") > 0)
        .select("row", "named", "n_tokens", F.posexplode("passages").alias("no", "passage"))
        .withColumn("words", _tokens(F.col("passage")))
    )
    counts = (
        passages.select("row", "named", "n_tokens", "no", F.size("words").alias("length"), F.explode("words").alias("token"))
        .groupBy("row", "named", "n_tokens", "no", "length", "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    # one row for each token of the templates: their number is that of the given templates
    idfs = F.broadcast(weights.select(F.col("token").alias("t"), "idf").distinct())
    weighed = counts.join(idfs, F.col("token") == F.col("t"), "left").withColumn("raw", F.col("tf") * F.coalesce("idf", unseen_idf(templates))).drop("t", "idf")
    passage = ["row", "named", "n_tokens", "no", "length"]
    norms = weighed.groupBy(*passage).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    dots = weighed.join(F.broadcast(weights.drop("idf")), "token").groupBy(*passage, "license").agg(F.sum(F.col("raw") * F.col("weight")).alias("dot"))
    best = (
        dots.join(norms, passage)
        .withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6))
        .where(F.col("similarity") >= MIN_COSINE)
        .groupBy(*passage)
        .agg(F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("best"))
    )
    return best.groupBy("row", "named", "n_tokens").agg(F.min("best").alias("best"), F.sum("length").alias("matched")).select(
        "row",
        F.col("best.license").alias("license"),
        (-F.col("best.less")).alias("similarity"),
        (F.col("named") | (2 * F.col("matched") >= F.col("n_tokens"))).alias("is_file"),
    )


def _texts() -> list[tuple[str, str]]:
    folder = resources.files("loomgraph.llm") / "license_texts"
    return sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in folder.iterdir() if f.name.endswith(".txt"))


def _own_words() -> list[tuple[str, str]]:
    """(license, text): full texts and headers."""
    return [(license, re.sub(NOTICE, "", text)) for license, text in _texts()] + list(HEADERS)


def _matches(passages: DataFrame, forms: list[tuple[str, str]]) -> DataFrame:
    """Of (row, named, n_tokens, no, words): the most alike form of MIN_COSINE or more for each passage, terms weighed 1 + log tf."""
    counts = [(license, Counter(re.findall(TOKEN, text.lower()))) for license, text in forms]
    held = Counter(t for _, c in counts for t in c)
    idf = {t: math.log((1 + len(forms)) / (1 + n)) + 1 for t, n in held.items()}
    unseen = math.log(1 + len(forms)) + 1
    weights = []
    for k, (license, c) in enumerate(counts):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        weights += [(k, license, t, x / norm) for t, x in raw.items()]
    spark = passages.sparkSession
    # their number is that of the given forms' tokens
    weights = F.broadcast(spark.createDataFrame(weights, "form int, license string, token string, weight double"))
    idfs = F.broadcast(spark.createDataFrame(sorted(idf.items()), "t string, idf double"))
    # one row for each passage with all its terms, so that texts are read once
    tf = passages.select("row", "named", "n_tokens", "no", F.size("words").alias("length"), F.explode("words").alias("token")).groupBy(*PASSAGE, "token").agg(F.count(F.lit(1)).alias("tf"))
    weighed = tf.join(idfs, F.col("token") == F.col("t"), "left").withColumn("raw", (1 + F.log("tf")) * F.coalesce("idf", F.lit(unseen)))
    terms = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("token", "raw"))).alias("terms")
    normed = weighed.groupBy(*PASSAGE).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), terms)
    dots = normed.select(*PASSAGE, "norm", F.inline("terms")).join(weights, "token").groupBy(*PASSAGE, "norm", "form", "license").agg(F.sum(F.col("raw") * F.col("weight")).alias("dot"))
    alike = dots.withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= MIN_COSINE)
    best = alike.groupBy(*PASSAGE).agg(F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("best"))
    return best.select("row", F.col("best.license").alias("license"), (-F.col("best.less")).alias("similarity"), "named", "length", "n_tokens")


def _told(files: DataFrame) -> DataFrame:
    """Of (row, path, text): row, tier, license, similarity, is_file by identifiers and own words (tier 0) and by names (tier 2)."""
    text = F.col("text").cast("string")
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    cued = files.select("row", named.alias("named"), F.regexp_replace(text, "\r", "").alias("text")).where(F.col("named") | F.lower("text").rlike(CUE))
    ids = sorted({license for license, _ in [*TEMPLATES, *_own_words()]} - {"Proprietary"})
    known = F.create_map(*[F.lit(x) for i in ids for x in (i.lower(), i)])
    said = F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))
    terms = F.flatten(F.transform(said, lambda x: F.split(F.lower(x), r"[^a-z0-9.+-]+")))
    found = F.array_compact(F.transform(terms, lambda x: F.element_at(known, F.regexp_replace(x, r"(-only|-or-later|\+)$", ""))))
    spdx = cued.select("row", F.lit(0).alias("tier"), F.array_min(found).alias("license"), F.lit(1.0).alias("similarity"), "named", F.size(_tokens(F.array_join(said, " "))).alias("length"), F.size(_tokens(F.col("text"))).alias("n_tokens")).where("license is not null")

    body = F.regexp_replace("text", NOTICE, "")
    bare = F.regexp_replace(F.regexp_replace(body, rf"(?m)^[ \t]*(?:{COMMENT})?[/*#;%!-]*[ \t]*", ""), r"(?m)[ \t]*(?:\*+/|-->)?[ \t]*$", "")
    # lines that are no comments part comment blocks, empty ones part paragraphs
    blocks = F.split(F.regexp_replace(body, rf"(?m)^(?![ \t]*(?:{COMMENT})).*$", "\x01"), "\x01")
    parts = F.filter(F.concat(blocks, F.split(bare, r"\n{2,}")), lambda x: F.lower(x).rlike(CUE))
    passages = (
        cued.select("row", "named", F.size(_tokens(F.col("text"))).alias("n_tokens"), F.posexplode(F.array_distinct(F.concat(F.array(body), parts))).alias("no", "passage"))
        .withColumn("words", _tokens(F.col("passage")))
        .where(F.size("words") >= LEAST_TOKENS)
    )
    own = _matches(passages, _own_words()).withColumn("tier", F.lit(0))

    lines = cued.select("row", "named", F.size(_tokens(F.col("text"))).alias("n_tokens"), F.posexplode(F.filter(F.split("text", "\n", -1), lambda x: F.lower(x).rlike(CUE))).alias("no", "passage")).withColumn("words", _tokens(F.col("passage")))
    names = _matches(lines.where(F.size("words") < LEAST_TOKENS), list(NAMES)).withColumn("tier", F.lit(2))
    return spdx.unionByName(own).unionByName(names).select("row", "tier", "license", "similarity", (F.col("named") | (2 * F.col("length") >= F.col("n_tokens"))).alias("is_file"))


def cued(files: DataFrame) -> DataFrame:
    """Files (row, path, text) that are named like a licence file or hold a cue, each once."""
    named, text = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)), F.col("text").cast("string")
    return files.where(named | F.lower(text).rlike(CUE)).select("row", "path", text.alias("text")).dropDuplicates(["row"])


def found_licenses(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Of (row, path, text), row telling path and text: row, license, similarity, is_file by what tells most, ties by name."""
    # all that follows reads these few texts alone
    files = written(cued(files))
    stated = own_licenses(files, templates).select("row", F.lit(1).alias("tier"), "license", "similarity", "is_file")
    best = F.min(F.struct("tier", (-F.col("similarity")).alias("less"), "license", (~F.col("is_file")).alias("no_file"))).alias("b")
    return _told(files).unionByName(stated).groupBy("row").agg(best).select("row", F.col("b.license").alias("license"), (-F.col("b.less")).alias("similarity"), (~F.col("b.no_file")).alias("is_file"))


def directory(path: Column) -> Column:
    """The directory of a path, '' for the root; null for null."""
    return F.when(path.isNotNull(), F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("")))


def ancestors(path: Column) -> Column:
    """All directories above a file, the root first, the nearest last."""
    parts = F.split(directory(path), "/", -1)
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))


def scan(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Of (row, path, text): row, license, similarity, inherited_license, inherited_from."""
    text = F.col("text").cast("string")
    keyed = files.select(F.xxhash64("path", text).alias("__file"), F.col("row").alias("__row"), "path", text.alias("text"))
    # written, as all that follows reads it: texts are compared once
    own = written(found_licenses(keyed.select(F.col("__file").alias("row"), "path", "text"), templates)).withColumnRenamed("row", "__file")
    held = keyed.select("__file", "__row", "path").join(own, "__file", "left")
    found = held.where("is_file").select(directory(F.col("path")).alias("dir"), "path", "license", "similarity").where("dir is not null")
    by_dir = found.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "path", "license")).alias("f")).select("dir", F.col("f.license").alias("dir_license"))
    bare = held.where("license is null").select("path")
    # files of one directory share their ancestors, so directories are looked up, not files
    places = bare.select(directory(F.col("path")).alias("of"), ancestors(F.col("path")).alias("above")).where("of is not null").distinct()
    near = places.select("of", F.explode("above").alias("dir")).join(by_dir, "dir").groupBy("of").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "dir_license")).alias("d"))
    near = near.select("of", F.col("d.dir").alias("inherited_from"), F.col("d.dir_license").alias("inherited_license"))
    joined = held.withColumn("of", F.when(F.col("license").isNull(), directory(F.col("path")))).join(near, "of", "left")
    return joined.select(F.col("__row").alias("row"), "license", "similarity", "inherited_license", "inherited_from")
