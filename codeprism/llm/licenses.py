"""License scans: TF-IDF cosine of files, headers, paragraphs, sentences and lines to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise, require

#: Header sentences of common licenses, by SPDX identifier.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-only": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-only": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "LicenseRef-AllRightsReserved": "All rights reserved.",
}
#: Cosine from which a line is a license statement, squared, as a fraction: 0.8^2 = 16/25.
COSINE_SQUARED = (16, 25)

_FREE = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
#: Notices that fill several lines and titles of license files. Versions that differ by a number only are told apart by having them all.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        _APACHE,
        _APACHE
        + " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "GPL-2.0-only": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0-only": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1-only": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0-only": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0-only": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "GPL-2.0-or-later": [_FREE.format("program", "General Public License", "2")],
    "GPL-3.0-or-later": [_FREE.format("program", "General Public License", "3")],
    "LGPL-2.1-or-later": [_FREE.format("library", "Lesser General Public License", "2.1")],
    "LGPL-3.0-or-later": [_FREE.format("library", "Lesser General Public License", "3")],
    "AGPL-3.0-or-later": [_FREE.format("program", "Affero General Public License", "3")],
}
#: What a statement can fill, widest first; of a file's statements the widest counts, of these the nearest.
UNITS = ("file", "header", "paragraph", "sentence", "line")
#: Names of license files.
LICENSE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying)([-_.][^/]*)?$"


@cache
def license_texts() -> dict[str, list[str]]:
    """All templates of each license: its sentence, its notices, its text (of the GPL and AGPL the title: their texts are too alike)."""
    out = {k: [v] for k, v in TEMPLATES.items()}
    for k, notices in NOTICES.items():
        out[k] = [*out.get(k, []), *notices]
    for at in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        out[at.stem] = [*out.get(at.stem, []), at.read_text(encoding="utf-8")]
    return out


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def terms(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits."""
    return F.array_distinct(words(text))


def _templates(docs: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    spark = docs.sparkSession
    return spark.createDataFrame(sorted(templates.items()), "license string, template string").select("license", terms(F.col("template")).alias("t_terms"))


def scan_lines(files: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """The best license statement of each file that has one by single lines alone: path, license, unit, line, cosine, license_file (false).

    The narrow scan that the SQL of op3_license_scan fixes; scan_texts compares whole files and headers as well. A term weighs round(1000 (1 + ln((1 + N) / (1 + df)))), N and df counted over all files; terms of no template count
    as if no file had them, so that only template terms need counting. Weights are whole numbers, dot products and
    squared norms exact. A line has each term once. A line can reach the cosine only if its unknown terms are at most
    9/16 of its known ones (each unknown one weighs as much as any known one): other lines are dropped before that.
    """
    known = _templates(files, TEMPLATES if templates is None else templates)
    vocabulary = sorted({w for (ws,) in known.select("t_terms").collect() for w in ws})  # of the templates: a fixed list
    listed = F.array(*[F.lit(w) for w in vocabulary])
    lines = files.select("path", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("line", "content"))
    # df of template terms over whole files, and their number
    n = files.count()
    seen = files.select(F.explode(F.array_intersect(terms(F.col("text")), listed)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = lambda df: F.round(F.lit(1000.0) * (F.lit(1.0) + F.log((F.lit(1.0) + F.lit(float(n))) / (F.lit(1.0) + df)))).cast("long")
    vocab = files.sparkSession.createDataFrame([(w,) for w in vocabulary], "term string")
    weights = vocab.join(seen, "term", "left").select("term", weight(F.coalesce("df", F.lit(0)).cast("double")).alias("w"))
    weights = weights.agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("weights"))
    norm = lambda ts: F.aggregate(ts, F.lit(0).cast("long"), lambda a, t: a + F.col("weights")[t] * F.col("weights")[t])
    rows = lines.select("path", "line", terms(F.col("content")).alias("ts")).withColumn("hit", F.array_intersect("ts", listed))
    rows = rows.where((F.size("hit") > 0) & ((F.size("ts") - F.size("hit")) * 16 <= F.size("hit") * 9))
    # one row of weights, one of each template: both bounded by the templates
    one = known.crossJoin(weights).select("license", "t_terms", norm(F.col("t_terms")).alias("t_norm"), "weights")
    table = one.agg(F.collect_list(F.struct("license", "t_terms", "t_norm")).alias("templates"), F.first("weights").alias("weights"))
    unseen = weight(F.lit(0.0))
    rows = rows.join(F.broadcast(table)).withColumn("norm", norm(F.col("hit")) + (F.size("ts") - F.size("hit")) * unseen * unseen)
    rows = rows.select("path", "line", "hit", "norm", "weights", F.explode("templates").alias("t")).withColumn("dot", norm(F.array_intersect("hit", "t.t_terms")))
    num, den = COSINE_SQUARED
    square = F.col("dot").cast("double") * F.col("dot").cast("double")
    norms = F.col("norm").cast("double") * F.col("t.t_norm").cast("double")
    rows = rows.select("path", F.col("t.license").alias("license"), "line", (square / norms).alias("square")).where(F.col("square") * den >= num)
    best = rows.groupBy("path").agg(F.min(F.struct((-F.col("square")).alias("s"), "line", "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), F.lit("line").alias("unit"), F.col("b.line").alias("line"), F.sqrt(-F.col("b.s")).alias("cosine"), F.lit(False).alias("license_file"))


def _comment_lines(lines: Column) -> Column:
    """How many lines the comments at the start of a file fill, blank ones among them included."""
    state = "struct<closer:string,done:boolean,n:int>"

    def step(at: Column, line: Column) -> Column:
        line = F.trim(F.regexp_replace(line, "^[\\s\\x{FEFF}]+", ""))
        opened = F.when(line.startswith("/*"), "*/").when(line.startswith("<!--"), "-->").when(line.startswith('"""'), '"""').when(line.startswith("'''"), "'''").otherwise("")
        closer = F.when((opened == "") | F.substring(line, 4, 2**31 - 1).contains(opened) | (F.substring(line, 3, 2) == "*/"), F.lit("")).otherwise(opened)
        comment = (line == "") | (opened != "") | line.rlike(r"^(#|//|\*|--|;|%|\.\.( |$))")
        inside = F.struct(F.when(line.contains(at["closer"]), F.lit("")).otherwise(at["closer"]).alias("closer"), F.lit(False).alias("done"), (at["n"] + 1).alias("n"))
        outside = F.struct(F.when(comment, closer).otherwise(F.lit("")).alias("closer"), (~comment).alias("done"), F.when(comment, at["n"] + 1).otherwise(at["n"]).alias("n"))
        return F.when(at["done"], at).when(at["closer"] != "", inside).otherwise(outside).cast(state)

    start = F.struct(F.lit("").alias("closer"), F.lit(False).alias("done"), F.lit(0).alias("n")).cast(state)
    return F.aggregate(lines, start, step, lambda at: at["n"])


def _units(text: Column) -> Column:
    """The whole text, the comments at its start, its paragraphs (lines without letter or digit part them), sentences and lines: structs (unit, content), unit a place in UNITS."""
    lines = F.split(text, "\n", -1)
    header = F.array_join(F.slice(lines, 1, _comment_lines(lines)), "\n")
    paragraphs = F.split(text, r"\n[^\p{L}\p{N}]*\n", -1)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?])[\s#*/;%-]+(?=\p{Lu})", -1)))
    tag = lambda k, column: F.transform(column, lambda c: F.struct(F.lit(k).alias("unit"), c.alias("content")))
    return F.concat(*[tag(k, c) for k, c in enumerate((F.array(text), F.array(header), paragraphs, sentences, lines))])


def _weight(n: int, df: Column) -> Column:
    """round(1000 (1 + ln((1 + N) / (1 + df)))): whole, so that sums of products are exact."""
    return F.round(F.lit(1000.0) * (F.lit(1.0) + F.log(F.lit(1.0 + n) / (F.lit(1.0) + df.cast("double"))))).cast("long")


def _needed(templates: Mapping[tuple[str, int], Mapping[str, int]], weights: Mapping[str, tuple[int, int]]) -> list[str]:
    """Terms of which any text within the cosine of any template has at least one, rare ones preferred.

    By Cauchy and Schwarz a text that shares the terms S of a template is within sqrt(norm of S / norm of all) of it:
    without terms that hold more than 9/25 of the norm it cannot reach 16/25.
    """
    num, den = COSINE_SQUARED
    found = set()
    for counts in templates.values():
        part = {t: (c * weights[t][0]) ** 2 for t, c in counts.items()}
        left = sum(part.values())
        limit = left * num * (1 - 1e-9)
        for t in sorted(part, key=lambda t: (-part[t] / (1 + weights[t][1]), t)):
            if left * den < limit:
                break
            left -= part[t]
            found.add(t)
    return sorted(found)


def scan_texts(files: DataFrame, templates: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The license statement of each file that has one: path, license, unit, cosine, license_file.

    Vectors are TF-IDF: a term counts as often as it occurs, times round(1000 (1 + ln((1 + N) / (1 + df)))), N and df
    counted over all files and terms. Each file as a whole, the comments at its start, each paragraph, sentence and line
    are compared with each template; of the units within the cosine the widest counts (see UNITS), of these the one with
    the largest cosine, the first, and the license that is smallest by code point. Files and units that lack the terms
    that any template needs are left out before, which loses none; sums are exact.
    """
    spark = files.sparkSession
    templates = license_texts() if templates is None else templates
    files = files.select("path", "text")
    n = files.count()
    seen = files.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    seen = materialise(seen.select("term", _weight(n, F.col("df")).alias("w"), "df"), "license-terms")
    # vectors of the templates, bounded by these: a fixed list
    texts = [(k, i, t) for k, ts in sorted(templates.items()) for i, t in enumerate(ts)]
    split = spark.createDataFrame(texts, "license string, i int, text string").select("license", "i", F.explode(words(F.col("text"))).alias("term"))
    known = split.select("term").distinct()
    rows = known.join(F.broadcast(known).join(seen, "term"), "term", "left").select("term", F.coalesce("w", _weight(n, F.lit(0))).alias("w"), F.coalesce("df", F.lit(0)).alias("df")).collect()
    weights = {r["term"]: (r["w"], r["df"]) for r in rows}
    counts: dict[tuple[str, int], dict[str, int]] = {}
    for r in split.groupBy("license", "i", "term").count().collect():
        counts.setdefault((r["license"], r["i"]), {})[r["term"]] = r["count"]
    parts = [(k, i, t, c * weights[t][0]) for (k, i), ts in sorted(counts.items()) for t, c in sorted(ts.items())]
    norms = [(k, i, float(sum((c * weights[t][0]) ** 2 for t, c in ts.items()))) for (k, i), ts in sorted(counts.items())]
    vocabulary = F.broadcast(spark.createDataFrame([(t, w) for t, (w, _) in sorted(weights.items())], "term string, w long"))
    vectors = F.broadcast(spark.createDataFrame(parts, "license string, i int, term string, v long"))
    norms = F.broadcast(spark.createDataFrame(norms, "license string, i int, t_norm double"))
    needed = F.array(*[F.lit(t) for t in _needed(counts, weights)]).cast("array<string>")
    # units of files that may hold a statement, with their terms
    kept = files.where(F.arrays_overlap(words(F.col("text")), needed))
    kept = materialise(kept.withColumn("id", F.monotonically_increasing_id()), "license-files")
    units = kept.select("id", F.posexplode(_units(F.col("text"))).alias("pos", "u")).select("id", "pos", "u.unit", words(F.col("u.content")).alias("ts"))
    units = units.where(F.arrays_overlap("ts", needed)).select("id", "pos", "unit", F.explode("ts").alias("term"))
    exact = lambda c: c.cast("decimal(18,0)")
    key = ["id", "pos", "unit"]
    tf = materialise(units.groupBy(*key, "term").agg(F.count("*").alias("tf")).join(vocabulary, "term", "left"), "license-units")
    square = lambda w: F.sum(exact(F.col("tf") * w) * exact(F.col("tf") * w))
    dots = tf.where("w is not null").join(vectors, "term").groupBy(*key, "license", "i").agg(F.sum(exact(F.col("tf") * F.col("w")) * exact(F.col("v"))).cast("double").alias("dot"))
    num, den = COSINE_SQUARED
    within = lambda norm, slack: F.col("dot") * F.col("dot") * den >= norm * F.col("t_norm") * (num * slack)
    # terms of no template weigh 1000 at least: pairs beyond the cosine even so are dropped, before the others are looked up
    least = tf.groupBy(*key).agg(square(F.coalesce("w", F.lit(1000))).cast("double").alias("least"))
    pairs = materialise(dots.join(norms, ["license", "i"]).join(least, key).where(within(F.col("least"), 1 - 1e-9)).drop("least"), "license-pairs")
    near = tf.join(pairs.select(*key).distinct(), key, "left_semi")
    other = near.where("w is null").select("term").distinct()
    other = bounded(seen.select("term", F.col("w").alias("w_other")).join(other, "term", "left_semi"), "license-others")
    norm = near.join(other, "term", "left").groupBy(*key).agg(square(F.coalesce("w", "w_other")).cast("double").alias("norm"))
    found = pairs.join(norm, key).where(within(F.col("norm"), 1)).withColumn("square", F.col("dot") * F.col("dot") / (F.col("norm") * F.col("t_norm")))
    found = found.join(kept.select("id", "path"), "id")
    best = found.groupBy("path").agg(F.min(F.struct("unit", (-F.col("square")).alias("s"), "pos", "license")).alias("b"))
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), F.col("b.unit") + 1)
    return best.select("path", F.col("b.license").alias("license"), unit.alias("unit"), F.sqrt(-F.col("b.s")).alias("cosine"), F.col("path").rlike(LICENSE_FILE).alias("license_file"))


def _dir(path: Column) -> Column:
    """The directory; of names without one, and of names below the root, the empty text."""
    return F.regexp_replace(path, "^[^/]*$|/[^/]*$", "")


def scan_licenses(files: DataFrame, templates: Mapping | None = None, statements: Callable[[DataFrame, Mapping | None], DataFrame] = scan_texts) -> DataFrame:
    """files (path, text, ...) with license, how ('header', 'inherited', 'none'), unit, cosine, from_dir.

    A file with a license statement has that license; statements finds them (see scan_texts), unit says what the
    statement fills. Else it inherits from the nearest directory at or above its own that holds a file with one, there
    from license files first (by name, see LICENSE_FILE; not with scan_lines), then from the file whose path is smallest. Directories
    are resolved first, each joined to its ancestors' paths, so work follows the number of directories and their depth,
    and files join their own directory only. The directory of paths without one is the empty text, above all relative ones.
    Null paths have neither directory nor inheritance; null and empty texts have no statement; rows that share a path
    count as one file with the best of their statements; other columns pass through (license, how, unit, cosine and
    from_dir are replaced).
    """
    require(files, ["path", "text"])
    files = files.drop("license", "how", "unit", "cosine", "from_dir")
    own = materialise(statements(files.where("path is not null").select("path", "text"), templates), "license-lines")
    holds = own.groupBy(_dir(F.col("path")).alias("dir")).agg(F.min(F.struct(~F.col("license_file"), "path", "license"))["license"].alias("dir_license"))
    dirs = files.where("path is not null").select(_dir(F.col("path")).alias("own_dir")).distinct()
    parts = F.split("own_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = dirs.select("own_dir", F.explode(F.array_union(F.array(F.lit("")), above)).alias("dir"))
    near = up.join(bounded(holds, "license-dirs"), "dir").groupBy("own_dir").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "dir_license")).alias("m"))
    near = near.select("own_dir", F.col("m.dir").alias("near_dir"), F.col("m.dir_license").alias("near_license"))
    own = own.select(F.col("path").alias("own_path"), F.col("license").alias("own_license"), F.col("unit").alias("own_unit"), F.col("cosine").alias("own_cosine"))
    # the caller's columns stay within a struct, so that no name of theirs meets one of these
    rows = files.select(F.struct(*files.columns).alias("row"), _dir(F.col("path")).alias("in_dir"))
    out = rows.join(bounded(own, "license-own"), F.col("row.path") == F.col("own_path"), "left").join(bounded(near, "license-near"), F.col("in_dir") == F.col("own_dir"), "left")
    how = F.when(F.col("own_license").isNotNull(), "header").when(F.col("near_license").isNotNull(), "inherited").otherwise("none")
    return out.select("row.*", F.coalesce("own_license", "near_license").alias("license"), how.alias("how"), F.col("own_unit").alias("unit"), F.col("own_cosine").alias("cosine"), F.when(F.col("own_license").isNull(), F.col("near_dir")).alias("from_dir"))
