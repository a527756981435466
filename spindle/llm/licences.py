"""Licence scans: notices by sparse TF-IDF cosine, and inheritance by folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.shared import staged

# Short notices by which licences are declared.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the 2-Clause BSD License.",
    "BSD-3-Clause": "Licensed under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
NOTICE = "licen[cs]|copyright|spdx|creative commons|public domain|redistribut|mozilla public"  # what a notice mentions
LICENCE_FILE = "^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
TERM = "[a-z0-9]+(?:[.][0-9]+)*"
LEAST = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), 0)


def scan_licences(files: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST, path_column: str = "path", text_column: str = "text") -> DataFrame:
    """(path, licence, similarity, origin, declared_in), a row per row of `files`.

    Every line of a text that mentions a licence, copyright or the like is a
    notice; in files named like LICENSE, COPYING or NOTICE the whole text is one
    too. Notices and templates are vectors of term counts times
    ln((1 + files) / (1 + files with the term)) + 1, where terms outside the
    templates count as in no file. The template with the largest cosine, of at
    least `least`, is the licence of the file (origin `own`; ties to the first
    name; similarity to six decimals). Other files take that of the nearest
    folder upwards that has a licence file with one (origin `inherited`); of
    several in a folder the most similar counts, then the first path. The rest
    have none: licence, similarity, origin and declared_in are null.

    Null and empty texts hold no notice. A null path is in no folder and matched
    by its own text only; rows that repeat a path share the best notice of all
    of them. An empty table gives an empty result; other columns are not looked
    at. Templates are few; everything else is joined by term, path and folder.
    """
    spark = files.sparkSession
    rows = files.select(F.col(path_column).cast("string").alias("path"), F.col(text_column).cast("string").alias("text"))
    vocabulary = spark.createDataFrame(list(templates.items()), "licence string, notice string")
    in_template = vocabulary.select("licence", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("licence", "term").agg(F.count("*").alias("tf"))
    known = sorted(r["term"] for r in in_template.select("term").distinct().collect())  # of the templates only

    present = F.explode(F.array_intersect(_terms(F.col("text")), F.array(*map(F.lit, known))))
    spread = rows.select(present.alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = F.lit(1.0 + rows.count())
    idf = F.log(total / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1
    weights = staged(in_template.select("term").distinct().join(spread, "term", "left").select("term", idf.alias("idf")), "terms")
    rarest = F.log(total) + 1

    name = F.element_at(F.split("path", "/"), -1)
    is_licence_file = F.coalesce(F.translate(name, UPPER, LOWER).rlike(LICENCE_FILE), F.lit(False))
    mentions = F.translate(F.col("text"), UPPER, LOWER).rlike(NOTICE)
    units = F.when(is_licence_file, F.concat(F.split("text", "\n"), F.array("text"))).otherwise(F.split("text", "\n"))
    lines = rows.where(mentions).select("path", is_licence_file.alias("is_file"), F.explode(units).alias("line"))
    notices = lines.where(F.translate(F.col("line"), UPPER, LOWER).rlike(NOTICE)).select("path", "is_file", _terms(F.col("line")).alias("terms")).distinct()
    counted = (
        notices.withColumn("notice", F.xxhash64("path", "terms"))
        .select("path", "is_file", "notice", F.explode("terms").alias("term"))
        .groupBy("path", "is_file", "notice", "term")
        .agg(F.count("*").alias("tf"))
    )
    weighed = counted.join(weights, "term", "left").select("path", "is_file", "notice", "term", (F.col("tf") * F.coalesce("idf", rarest)).alias("weight"))
    vectors = staged(weighed, "notices")
    lengths = vectors.groupBy("path", "is_file", "notice").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    model = in_template.join(weights, "term").select("licence", "term", (F.col("tf") * F.col("idf")).alias("template_weight"))
    model_lengths = model.groupBy("licence").agg(F.sqrt(F.sum(F.col("template_weight") * F.col("template_weight"))).alias("template_length"))
    products = vectors.join(model, "term").groupBy("path", "is_file", "notice", "licence").agg(F.sum(F.col("weight") * F.col("template_weight")).alias("product"))
    keys = F.col("l.path").eqNullSafe(F.col("p.path")) & (F.col("l.notice") == F.col("p.notice"))
    cosines = products.alias("p").join(model_lengths, "licence").join(lengths.alias("l"), keys)
    similarity = F.round(F.col("product") / (F.col("template_length") * F.col("length")), 6)
    ranked = cosines.select("p.path", "p.is_file", "licence", similarity.alias("similarity")).where(F.col("similarity") >= least)
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("licence").alias("l")))
    own = staged(ranked.groupBy("path", "is_file").agg(best.alias("best")).select("path", "is_file", F.col("best.l").alias("licence"), (-F.col("best.s")).alias("similarity")), "own")

    folder = lambda p: F.regexp_extract(p, "^(.*)/[^/]*$", 1)
    first = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("path").alias("p"), F.col("licence").alias("l")))
    declared = own.where("is_file AND path IS NOT NULL").groupBy(folder(F.col("path")).alias("folder")).agg(first.alias("first"))
    holders = declared.select(F.col("folder").alias("above"), F.col("first.p").alias("declared_in"), F.col("first.l").alias("folder_licence"), (-F.col("first.s")).alias("folder_similarity"))
    parts = F.split("folder", "/")
    upwards = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    folders = staged(rows.where("path IS NOT NULL").select(folder(F.col("path")).alias("folder")).distinct(), "folders")
    above = folders.select("folder", upwards.alias("above")).distinct().join(holders, "above")
    nearest = F.max_by(F.struct("declared_in", "folder_licence", "folder_similarity"), F.length("above"))
    inherited = staged(above.groupBy("folder").agg(nearest.alias("near")).select("folder", "near.*"), "inherited")

    mine = own.select(F.col("path").alias("own_path"), "licence", "similarity")
    placed = rows.select("path", folder(F.col("path")).alias("folder"))
    found = placed.join(mine, F.col("path").eqNullSafe(F.col("own_path")), "left").join(inherited, "folder", "left")
    has = F.col("licence").isNotNull()
    return found.select(
        "path",
        F.coalesce("licence", "folder_licence").alias("licence"),
        F.coalesce("similarity", "folder_similarity").alias("similarity"),
        F.when(has, F.lit("own")).when(F.col("declared_in").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("declared_in")).alias("declared_in"),
    )


def document_files(documents: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id. One whose first line mentions a
    licence stands for a licence file of its folder."""
    opens = F.coalesce(F.translate(F.substring_index("text", "\n", 1), UPPER, LOWER).rlike(NOTICE), F.lit(False))
    name = F.concat(F.when(opens, F.lit("LICENSE.")).otherwise(F.lit("")), F.col("doc_id").cast("string"))
    return documents.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), name).alias("path"), "text")


_LOW = f"translate({{}}, '{UPPER}', '{LOWER}')"
_LIST = ", ".join("('{}', '{}')".format(*t) for t in TEMPLATES.items())
SCAN_SQL = f"""
WITH files AS (SELECT concat_ws('/', coalesce(source, ''), coalesce(lang, ''),
    CASE WHEN coalesce(regexp_matches({_LOW.format("split_part(text, chr(10), 1)")}, '{NOTICE}'), false) THEN 'LICENSE.' ELSE '' END || doc_id::VARCHAR) AS path, text FROM documents),
templates(licence, notice) AS (VALUES {_LIST}),
template_terms AS (SELECT licence, term, count(*) AS tf FROM (SELECT licence, unnest(regexp_extract_all({_LOW.format("notice")}, '{TERM}')) AS term FROM templates) GROUP BY ALL),
total AS (SELECT count(*) AS files FROM files),
spread AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all({_LOW.format("text")}, '{TERM}'))) AS term FROM files) WHERE term IN (SELECT term FROM template_terms) GROUP BY term),
weights AS (SELECT term, ln((1.0::DOUBLE + files) / (1.0::DOUBLE + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM template_terms) LEFT JOIN spread USING (term), total),
named AS (SELECT path, text, regexp_matches({_LOW.format("split_part(path, '/', -1)")}, '{LICENCE_FILE}') AS is_file FROM files WHERE regexp_matches({_LOW.format("text")}, '{NOTICE}')),
lines AS (SELECT path, is_file, unnest(string_split(text, chr(10))) AS line FROM named UNION ALL SELECT path, is_file, text FROM named WHERE is_file),
notices AS (SELECT DISTINCT path, is_file, regexp_extract_all({_LOW.format("line")}, '{TERM}') AS terms FROM lines WHERE regexp_matches({_LOW.format("line")}, '{NOTICE}')),
numbered AS (SELECT row_number() OVER () AS notice, * FROM notices),
vectors AS (SELECT path, is_file, notice, t.term, count(*) * any_value(coalesce(idf, ln(1.0::DOUBLE + files) + 1)) AS weight
    FROM (SELECT path, is_file, notice, unnest(terms) AS term FROM numbered) t LEFT JOIN weights USING (term), total GROUP BY ALL),
lengths AS (SELECT notice, sqrt(sum(weight * weight)) AS length FROM vectors GROUP BY notice),
model AS (SELECT licence, term, tf * idf AS template_weight FROM template_terms JOIN weights USING (term)),
model_lengths AS (SELECT licence, sqrt(sum(template_weight * template_weight)) AS template_length FROM model GROUP BY licence),
cosines AS (SELECT path, is_file, licence, round(sum(weight * template_weight) / (any_value(template_length) * any_value(length)), 6) AS similarity
    FROM vectors JOIN model USING (term) JOIN model_lengths USING (licence) JOIN lengths USING (notice) GROUP BY path, is_file, notice, licence),
own AS (SELECT path, is_file, licence, similarity FROM cosines WHERE similarity >= {LEAST} QUALIFY row_number() OVER (PARTITION BY path ORDER BY similarity DESC, licence) = 1),
declared AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path AS declared_in, licence AS folder_licence, similarity AS folder_similarity
    FROM own WHERE is_file QUALIFY row_number() OVER (PARTITION BY folder ORDER BY similarity DESC, path) = 1),
placed AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM files),
inherited AS (SELECT p.folder, d.* EXCLUDE (folder) FROM (SELECT DISTINCT folder FROM placed) p JOIN declared d ON p.folder = d.folder OR starts_with(p.folder, d.folder || '/') OR d.folder = ''
    QUALIFY row_number() OVER (PARTITION BY p.folder ORDER BY length(d.folder) DESC) = 1)
SELECT placed.path, coalesce(licence, folder_licence) AS licence, coalesce(similarity, folder_similarity) AS similarity,
    CASE WHEN licence IS NOT NULL THEN 'own' WHEN declared_in IS NOT NULL THEN 'inherited' END AS origin,
    CASE WHEN licence IS NOT NULL THEN placed.path ELSE declared_in END AS declared_in
FROM placed LEFT JOIN own ON placed.path = own.path LEFT JOIN inherited ON placed.folder = inherited.folder
"""
