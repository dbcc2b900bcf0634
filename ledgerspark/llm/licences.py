"""Licence scan by MinHash over text windows, in DataFrame functions only.

A text is a sequence of 5-word shingles. For a template of m shingles it is read in windows of 2 m shingles that overlap by
half, so every passage of the template's length lies whole in some window. BANDS MinHash values of a window, each a band of
its own, are joined with those of the templates. A window that holds at least CONTAINMENT of a template has a Jaccard
similarity of at least 0.8 / 2.2 with it, so it misses all 32 bands in fewer than one case in a million. Matches are
then verified by the exact share of the template's shingles that the window contains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import common as C
from ledgerspark.session import materialise

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 32

#: Wording of common licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mit": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Lower-cased words of letters, digits and all code points above ASCII.
_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, use) -> Column:
    """use(value) with value evaluated once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(text: Column) -> Column:
    """64-bit hashes of the 5-word shingles of a text in order; none for null and texts of fewer words."""
    folded = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "^" + _BETWEEN_WORDS + "|" + _BETWEEN_WORDS + "$", "")
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - SHINGLE)
    hashed = lambda w: F.transform(starts(w), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    none = F.array().cast("array<bigint>")
    return _let(F.split(folded, _BETWEEN_WORDS), lambda w: F.when(F.size(w) < SHINGLE, none).otherwise(hashed(w)))


def band_keys(window: Column) -> Column:
    """One key per band: the smallest of the window's shingles under the band's hash function."""
    def key(band: int) -> Column:
        return F.xxhash64(F.lit(band), F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(band)))))

    return F.array(*[key(band) for band in range(BANDS)])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, licences array<string>, containment) of every row of docs.

    licences: ids of the templates of which some window contains at least `containment` of the shingles, sorted;
    containment: the largest such share, 0 without a match. Templates of fewer than five words can't be told from common
    speech and match nothing. Null, empty and short texts match nothing. Repeated rows each get the same result.
    """
    spark = docs.sparkSession
    texts = spark.createDataFrame(sorted((TEMPLATES if templates is None else templates).items()), "licence string, text string")
    known = texts.select("licence", F.array_distinct(shingles(F.col("text"))).alias("parts")).where("size(parts) > 0")
    # The templates come from the caller's memory, so their hashes fit into a literal.
    parts = known.collect()
    wanted = F.array(*[F.lit(x) for x in sorted({x for r in parts for x in r.parts})]).cast("array<bigint>")
    read = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("content"), shingles(F.col(text_col)).alias("h"))
    # A window without any template shingle neither collides nor contains: only texts with one go on, the others keep no array.
    rows = materialise(read.select("doc_id", "content", F.size("h").alias("n"), F.when(F.arrays_overlap("h", wanted), F.col("h")).alias("h")), "shingles")
    sizes = sorted({len(r.parts) for r in parts})
    if not sizes:
        return rows.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.array().cast("array<string>").alias("licences"), F.lit(0.0).alias("containment"))
    hit = rows.where("h is not null").dropDuplicates(["doc_id", "content"])
    starts = hit.select("doc_id", "content", "h", F.explode(F.array(*map(F.lit, sizes))).alias("m")).withColumn(
        "start", F.explode(F.expr("sequence(0, size(h) - 1, m)"))
    )
    windows = starts.select(
        "doc_id", "content", "m", "start", F.array_distinct(F.slice("h", F.col("start") + 1, F.col("m") * 2)).alias("window")
    ).where(F.arrays_overlap("window", wanted))
    banded = known.select("licence", "parts", F.size("parts").alias("m"), F.explode(band_keys(F.col("parts"))).alias("key"))
    met = windows.withColumn("key", F.explode(band_keys(F.col("window")))).join(banded, ["m", "key"])
    share = F.size(F.array_intersect("window", "parts")) / F.size("parts")
    # A pair may meet in several bands; the largest share per text and template leaves one row of it.
    matches = met.select("doc_id", "content", "licence", share.alias("share")).where(F.col("share") >= containment)
    found = matches.groupBy("doc_id", "content", "licence").agg(F.max("share").alias("share")).groupBy("doc_id", "content").agg(
        F.array_sort(F.collect_list("licence")).alias("licences"), F.max("share").alias("containment")  # at most one per template
    ).select(F.col("doc_id").alias("found_id"), F.col("content").alias("found_content"), "licences", "containment")
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("content") == F.col("found_content"))
    return rows.select("doc_id", "content", "n").join(found, same, "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.coalesce("licences", F.array().cast("array<string>")).alias("licences"), F.coalesce("containment", F.lit(0.0)).alias("containment"),
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_shingles", F.size("licences").cast("bigint").alias("n_licences"), F.array_join("licences", ",").alias("licences"), "containment"
    )


def _values() -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH t AS (SELECT licence, {_WORDS} AS w FROM (VALUES {_values()}) v(licence, text)),
ts AS (SELECT DISTINCT licence, array_to_string(w[p:p + {SHINGLE - 1}], ' ') AS s
       FROM (SELECT licence, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS p FROM t)),
tm AS (SELECT licence, s, count(*) OVER (PARTITION BY licence) AS m FROM ts),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ds AS (SELECT doc_id, p - 1 AS i, array_to_string(w[p:p + {SHINGLE - 1}], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS p FROM d WHERE len(w) >= {SHINGLE})),
o AS (SELECT doc_id, licence, m, i // m AS k, s FROM ds JOIN tm USING (s)),
x AS (SELECT * FROM o UNION ALL SELECT doc_id, licence, m, k - 1, s FROM o WHERE k > 0),
c AS (SELECT doc_id, licence, k, count(DISTINCT s) * 1.0 / m AS share FROM x GROUP BY doc_id, licence, m, k),
f AS (SELECT doc_id, licence, CAST(max(share) AS DOUBLE) AS share FROM c WHERE share >= {CONTAINMENT} GROUP BY doc_id, licence),
g AS (SELECT doc_id, count(*) AS n_licences, string_agg(licence, ',' ORDER BY licence) AS licences, max(share) AS containment FROM f GROUP BY doc_id)
SELECT d.doc_id, greatest(len(w) - {SHINGLE - 1}, 0) AS n_shingles, coalesce(n_licences, 0) AS n_licences, coalesce(licences, '') AS licences,
       coalesce(containment, CAST(0 AS DOUBLE)) AS containment
FROM d LEFT JOIN g USING (doc_id)
"""

QUERIES = {"op3_licences": op3_licences}
ORACLE_SQL = {"op3_licences": OP3_SQL}
