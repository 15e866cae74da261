"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Templates are licence texts, standard headers, statements that name a licence and SPDX lines. A file is cut into pieces: the
whole text of a licence file, blocks and runs of comment lines that speak of licences, single such lines. Each distinct piece
is one sparse vector and compared once with all templates; the best cosine wins. Files without a recognised piece inherit the
licence of the nearest directory above that holds a recognised licence file, by joins on directory paths. Built-in DataFrame
functions only.
"""

from __future__ import annotations

import os
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.llm.shared import kept, lower_ascii

# Statements by which files name their licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# Names of licences in short statements.
NAMES = (
    ("AGPL-3.0", ("GNU Affero General Public License version 3", "AGPL v3")),
    ("Apache-2.0", ("Apache License 2.0", "Apache-2.0", "Apache Software License 2.0")),
    ("BSD-2-Clause", ("BSD 2-Clause", "Simplified BSD")),
    ("BSD-3-Clause", ("BSD 3-Clause", "New BSD", "Modified BSD")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("GPL-2.0", ("GNU General Public License version 2", "GNU GPL v2", "GPL v2")),
    ("GPL-3.0", ("GNU General Public License version 3", "GNU GPL v3", "GPL v3")),
    ("ISC", ("ISC",)),
    ("LGPL-2.1", ("GNU Lesser General Public License version 2.1", "LGPL v2.1")),
    ("LGPL-3.0", ("GNU Lesser General Public License version 3", "LGPL v3")),
    ("MIT", ("MIT", "Expat")),
    ("MPL-2.0", ("Mozilla Public License 2.0", "MPL 2.0")),
)
#: Licences of which two are often offered for choice.
CHOICES = ("MIT", "Apache-2.0", "BSD-3-Clause", "MPL-2.0", "GPL-2.0", "GPL-3.0")
#: Licences that vary the text of CC-BY-SA-4.0.
CREATIVE_COMMONS = (
    ("CC-BY-4.0", "Attribution"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial"),
    ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives"),
    ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike"),
    ("CC-BY-ND-4.0", "Attribution-NoDerivatives"),
)
#: Licence texts and standard headers, one file each, named by licence and form.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")

#: Cosine a piece needs.
THRESHOLD = 0.6
#: Weight of a word that no template has.
UNSEEN = 2.0
LINE = "licen[cs]e|copyright|spdx"
#: Lines that say who holds the rights, in lower case.
HOLDER = r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4})|c\)[ \t]*[0-9]{4}|©)[^\n]*\n?"
COMMENT = r"^[ \t]*(?:#|//|/\*|\*|--|;|%|<!--)"
BLANK = r"\n[ \t\r]*\n"
#: Where a sentence ends together with its line.
SENTENCE = r"\n[ \t\r]*\n|[.][ \t\r]*\n"
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|copyright)[^/]*$"
WORD = r"[a-z0-9]+(?:[.][0-9]+)*"


def _varied(base: str, title: str) -> str:
    """The text of a Creative Commons licence from that of CC-BY-SA-4.0: its name, with or without the parts its title adds."""
    parts = base.split("\n\n")
    if "ShareAlike" not in title:
        start = next(k for k, part in enumerate(parts) if part.strip() == "b. ShareAlike.")
        end = next(k for k, part in enumerate(parts) if k > start and part.strip().startswith("Section 4"))
        parts = parts[:start] + parts[end:]
        parts = [p for p in parts if not any(name in p for name in ("Adapter's License", "BY-SA Compatible", "License Elements"))]
    text = "\n\n".join(parts).replace("Attribution-ShareAlike", title)
    if "NonCommercial" in title:
        text += (
            "\nNonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation."
            "\nreproduce and Share the Licensed Material, in whole or in part, for NonCommercial purposes only"
        )
    if "NoDerivatives" in title:
        text += "\nproduce and reproduce, but not Share, Adapted Material; NoDerivatives"
    return text


def statements() -> list[tuple[str, str]]:
    """(license, statement) of all templates: texts and headers, statements with a licence's name, SPDX lines."""
    found = list(TEMPLATES)
    for name in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, name), encoding="utf-8") as file:
            found.append((name.rsplit("_", 1)[0], file.read()))
    base = dict(found)["CC-BY-SA-4.0"]
    found += [(license, _varied(base, title)) for license, title in CREATIVE_COMMONS]
    known = sorted({license for license, _ in found} | {license for license, _ in NAMES})
    found += [(license, f"SPDX-License-Identifier: {license}") for license in known]
    found += [(f"{a} OR {b}", f"SPDX-License-Identifier: {a} OR {b}") for a, b in combinations(CHOICES, 2)]
    found += [(license, f"Licensed under the {name} License.") for license, names in NAMES for name in names]
    return found


def template_table(spark: SparkSession, templates=None) -> DataFrame:
    return spark.createDataFrame(statements() if templates is None else list(templates), "license string, statement string")


def plain(text: Column) -> Column:
    """Text in lower case without the lines of holders."""
    return F.regexp_replace(lower_ascii(text), HOLDER, "")


def pieces(path: Column, text: Column) -> Column:
    """Distinct (rank, piece) of a file: 0 the whole text of a licence file, 1 blocks, 2 lines that speak of licences.

    Blocks lie between blank lines, or are runs of comment lines. In a licence file, whose text may name other licences, whole
    sentences that end with their line stand for the lines. NULL without a text; empty if nothing speaks of licences.
    """
    lines = F.split(plain(text), "\n")
    speaks = lambda piece: piece.rlike(LINE)
    comments = F.array_join(F.transform(lines, lambda line: F.when(line.rlike(COMMENT), line).otherwise("")), "\n")
    blocks = F.filter(F.concat(F.split(plain(text), BLANK), F.split(comments, BLANK)), speaks)
    ranked = lambda rank, parts: F.transform(parts, lambda p: F.struct(F.lit(rank).alias("rank"), p.alias("piece")))
    whole = ranked(0, F.filter(F.array(plain(text)), lambda piece: piece.rlike("[a-z0-9]")))
    named = F.coalesce(path.rlike(FILE_NAME), F.lit(False))
    single = ranked(2, F.filter(F.when(named, F.split(plain(text), SENTENCE)).otherwise(lines), speaks))
    inside = F.concat(F.when(named, whole).otherwise(F.filter(whole, lambda _: F.lit(False))), ranked(1, blocks), single)
    # The flag ignores case of A-Z only, as `lower_ascii` does.
    return F.when(named | text.rlike(f"(?i){LINE}"), F.array_distinct(inside)).when(text.isNotNull(), F.filter(whole, lambda _: F.lit(False)))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def words_of(piece: Column) -> Column:
    """Words in lower case; versions lose their v and a last .0, so 2.0, v2 and GPLv2 hold the word 2."""
    spaced = F.regexp_replace(F.regexp_replace(lower_ascii(piece), "pl-?v ?([0-9])", "pl $1"), r"(^|[^a-z0-9])v\.? ?([0-9])", "$1 $2")
    return F.transform(F.regexp_extract_all(spaced, F.lit(WORD), F.lit(0)), lambda word: F.regexp_replace(word, r"\.0$", ""))


def _terms(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, tf): 1 + ln of how often each word stands in a piece."""
    found = rows.select(*keys, F.explode("words").alias("term")).groupBy(*keys, "term")
    return found.agg((F.log(F.count("*").cast("double")) + 1).alias("tf"))


def template_vectors(templates: DataFrame) -> DataFrame:
    """(template, license, term, idf, t) of `templates` (license, statement): every word's weight, in vectors of length one.

    A word's inverse frequency counts templates, so it does not depend on the files.
    """
    plain_rows = templates.where("license IS NOT NULL").select("license", plain(F.col("statement")).alias("statement")).distinct()
    numbered = kept(plain_rows.select(F.md5(F.concat_ws("\n", "license", "statement")).alias("template"), "license", words_of(F.col("statement")).alias("words")))
    terms = _terms(numbered, "template", "license")
    total = float(numbered.count() + 1)
    idf = terms.groupBy("term").agg(F.log(F.lit(total) / F.count("*")).alias("idf"))
    weights = kept(terms.join(idf, "term").withColumn("t", F.col("tf") * F.col("idf")))
    lengths = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("length"))
    return kept(weights.join(lengths, "template").select("template", "license", "term", "idf", (F.col("t") / F.col("length")).alias("t")))


def matched(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(key, license, similarity) of distinct `found` (key, words): the best template of each that shares a word.

    Ties go to the licence that sorts first. Similarities are rounded to 6 places before they are compared. Words are shuffled
    once, as one row a piece by its key; they are counted, weighed and compared where they then lie.
    """
    vectors = template_vectors(templates)
    terms = _terms(found.select("key", "words").repartition("key"), "key")
    idf = vectors.select("term", "idf").distinct()
    own = terms.join(idf, "term", "left").select("key", "term", (F.col("tf") * F.coalesce("idf", F.lit(UNSEEN))).alias("w"))
    norms = own.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = own.join(vectors.drop("idf"), "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    near = F.round(F.col("dot") / F.col("norm"), 6)
    best = dots.join(norms, "key").groupBy("key").agg(F.min(F.struct((-near).alias("order"), "license")).alias("best"))
    return best.select("key", "best.license", (-F.col("best.order")).alias("similarity"))


def scan(
    files: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, id_column: str = "id",
    path_column: str = "path", text_column: str = "text",
) -> DataFrame:
    """One row (id, path, own_license, similarity, license, license_from) per row of `files`.

    own_license is that of the template nearest to a piece of the file, if the cosine reaches `threshold`: a whole licence file
    decides before its blocks and a block before lines, of equal rank the best cosine, then the licence that sorts first.
    similarity is that cosine, or the file's best where none reaches it; NULL if no piece shares a word with a template. license
    is own_license or else that of the nearest directory above, the file's own first, with a recognised licence file; license_from
    is the path it comes from. Of several licence files in a directory the most similar counts, then the first path. NULL and
    empty texts have no piece; a NULL path is no licence file and inherits nothing; texts of any length count whole. Equal rows
    come out as often as they came in; other columns are ignored.
    """
    templates = template_table(files.sparkSession) if templates is None else templates
    path = F.col(path_column)
    cut = files.select(
        F.col(id_column).alias("id"), path.alias("path"), directory_of(path).alias("directory"),
        pieces(path, F.col(text_column)).alias("pieces"),
    )
    marks = F.transform("pieces", lambda p: F.struct(p["rank"].alias("rank"), F.md5(p["piece"]).alias("mark")))
    whole = F.when(F.size("pieces") > 0, F.md5(F.array_join(F.transform(marks, lambda m: F.concat(m["rank"].cast("string"), m["mark"])), ",")))
    # From here on there are paths and what speaks of licences. Files without it have keys of their own, so they do not meet.
    nothing = F.concat_ws("-", F.lit("-"), F.xxhash64("id", "path"))
    read = kept(cut.withColumn("marks", marks).withColumn("whole", F.coalesce(whole, nothing)))
    speaking = read.where(F.size("pieces") > 0)
    single = speaking.select(F.explode("pieces").alias("p")).select("p.piece").distinct()
    # Written once, so the numbers stay; from here on a number or mark stands for the piece.
    numbered = kept(single.select(F.monotonically_increasing_id().alias("key"), F.md5("piece").alias("mark"), words_of(F.col("piece")).alias("words")))
    found = kept(matched(numbered, templates).join(numbered.select("key", "mark"), "key").drop("key"))
    sorts = speaking.groupBy("whole").agg(F.any_value("marks").alias("marks")).select("whole", F.explode("marks").alias("m"))
    order = F.struct((F.col("similarity") < threshold).alias("below"), F.when(F.col("similarity") >= threshold, F.col("m.rank")).alias("rank"), (-F.col("similarity")).alias("order"), "license")
    best = kept(sorts.join(found, F.col("m.mark") == F.col("mark")).groupBy("whole").agg(F.min(order).alias("best")))
    own = read.select("id", "path", "directory", "whole").join(best, "whole", "left").select(
        "id", "path", "directory", (-F.col("best.order")).alias("similarity"),
        F.when(~F.col("best.below"), F.col("best.license")).alias("own_license"),
    )
    marked = (
        own.where(F.col("own_license").isNotNull() & F.col("path").rlike(FILE_NAME))
        .groupBy("directory")
        .agg(F.min(F.struct((-F.col("similarity")).alias("order"), "path", "own_license")).alias("best"))
        .select(F.col("directory").alias("above"), "best.path", "best.own_license")
        .toDF("above", "from_path", "from_license")
    )
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inherited = (
        read.select("directory")
        .where("directory IS NOT NULL")
        .distinct()
        .select("directory", F.posexplode(above).alias("depth", "above"))
        .join(marked, "above")
        .groupBy("directory")
        .agg(F.max(F.struct("depth", "from_license", "from_path")).alias("nearest"))
    )
    return own.join(inherited, "directory", "left").select(
        "id", "path", "own_license", "similarity",
        F.coalesce("own_license", "nearest.from_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("nearest.from_path")).alias("license_from"),
    )
