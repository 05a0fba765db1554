"""License scan in DataFrame operations alone: sparse TF-IDF cosine of headers and licence files to templates, then
inheritance from the nearest ancestor directory by path joins.

A *block* is a line of the text that holds a cue (``CUES``). Equal blocks are scored once, with their number as weight.
Term weights are term frequency times ``ln((1 + N) / (1 + df)) + 1`` over all blocks of the corpus. A block matches
the template with the largest cosine if that is at least ``least``; of a document's blocks the best counts.

Clauses and licences that run over lines are found in the joined lines of the document: a text (``TEMPLATES`` and the
whole licences of ``license_texts``) is held by a document that has ``held`` of its runs of three words. A whole
licence goes before a line, a line before a clause; of whole licences, or of clauses, that with the most runs in the document counts.

A document whose matching blocks together make up at least ``file_share`` of its words is a licence file and speaks for its
directory; a document without a licence of its own takes that of its nearest ancestor directory that has one.

Defined cases: a null or empty text has no block; a null path counts as an empty one, in the root directory; ties of a block go to the
first template by name, ties of a document to the first licence by name, ties of a directory to the first path
by name; rows with one path are one file; repeated rows each get a row; texts of any length are scanned whole; an empty table gives an
empty result; other columns, whatever their names, are left alone. A line is compared only if it holds a cue.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from .common import Scratch

# fixed values: licence, kind of template, text
TEMPLATES = [
    ("AGPL-3.0", "header", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, either version 3 of the License"),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "header", "Licensed under the BSD 2-Clause License, the simplified BSD license."),
    ("BSD-3-Clause", "header", "Use of this source code is governed by a BSD-style license. Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "header", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "header", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "notice", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "header", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "notice", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "header", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal license."),
    ("EPL-2.0", "header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "header", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "header", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License"),
    ("ISC", "header", "Released under the ISC License."),
    ("ISC", "notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License; either version 2.1 of the License"),
    ("LGPL-3.0", "header", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "notice", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, either version 3 of the License"),
    ("MIT", "header", "Released under the MIT License."),
    ("MIT", "notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "header", "This is free and unencumbered software released into the public domain, the Unlicense."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
]
# fixed values: a block holds one of these, in lower case
CUES = ["licens", "licenc", "copyright", "spdx", "permission is hereby", "permission to use", "redistribut", "creative commons", "public domain"]
#: Share of GPL-3.0 that a text with Affero in its first 300 characters holds.
AFFERO_HELD = 0.7
WORD = r"[^a-z0-9.+-]+"


def _terms(text):
    words = F.transform(F.split(F.lower(text), WORD), lambda w: F.regexp_replace(w, r"^[.+-]+|[.+-]+$", ""))
    return F.filter(words, lambda w: w != "")


def _cued(text):
    low, found = F.lower(text), F.lit(False)
    for cue in CUES:
        found = found | F.contains(low, F.lit(cue))
    return found


def _runs(terms):
    """Distinct runs of three terms."""
    n = F.greatest(F.size(terms), F.lit(1))
    two = F.zip_with(terms, F.slice(terms, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(F.zip_with(two, F.slice(terms, F.lit(3), n), lambda a, b: F.concat(a, F.lit(" "), b)), lambda r: r.isNotNull()))


def _held(row: DataFrame, held: float) -> DataFrame:
    """path, license, score, share, whole of the licence texts that the joined lines of each path hold."""
    texts = [(p.stem, "whole", p.read_text()) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))]
    known = row.sparkSession.createDataFrame(TEMPLATES + texts, "license string, kind string, body string")
    known = known.withColumn("runs", _runs(_terms("body"))).select("license", "kind", F.size("runs").alias("size"), F.explode("runs").alias("run"))
    files = row.filter(_cued("text")).select("path", F.xxhash64("text").alias("copy"), F.transform(F.array(_terms("text")), lambda t: F.struct(_runs(t).alias("runs"), F.size(t).alias("words")))[0].alias("of"), F.substring(F.lower("text"), 1, 300).contains("affero").alias("affero"))
    met = files.select("path", "copy", "affero", F.col("of.words").alias("words"), F.explode("of.runs").alias("run")).join(F.broadcast(known), "run")
    # repeated rows of a path hold the same runs; so many runs cover two words more
    n = met.groupBy("path", "copy", "affero", "words", "license", "kind", "size").agg(F.count_distinct("run").alias("n"))
    score, whole = F.round(F.col("n") / F.col("size"), 6), F.col("kind") == "whole"
    # the Affero licence repeats most of GPL-3.0 under its own title and has no text here
    affero = F.col("affero") & whole & (F.col("license") == "GPL-3.0")
    n = n.withColumn("score", score).withColumn("whole", whole).withColumn("as", F.when(affero, "AGPL-3.0").otherwise(F.col("license")))
    n = n.filter(F.col("score") >= F.when(affero, F.lit(AFFERO_HELD)).otherwise(F.lit(held))).withColumn("license", F.col("as"))
    first = F.struct(~F.col("whole"), -F.col("n"), F.col("license"))
    return n.groupBy("path").agg(*[F.min_by(c, first).alias(c) for c in ("license", "score", "whole")], F.min_by((F.col("n") + 2) / F.col("words"), first).alias("share"))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "path", least: float = 0.5, file_share: float = 0.25, held: float = 0.9) -> DataFrame:
    """doc_id, path, license, origin ('own', 'inherited' or 'none'), origin_path, score (of the own licence) for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "license")
    row = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(text).alias("text"))
    lines = row.filter(_cued("text")).select("path", F.xxhash64("text").alias("copy"), F.size(_terms("text")).alias("words"), F.explode(F.split("text", r"\n")).alias("block")).filter(_cued("block"))
    lines = scratch.write(lines, "lines")
    blocks = scratch.write(lines.groupBy("block").agg(F.count("*").alias("n")), "blocks")
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tf = blocks.select("block", "n", F.explode(_terms("block")).alias("term")).groupBy("block", "n", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(F.lit(1 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weighed = tf.join(df, "term").withColumn("w", F.col("tf") * idf)
    norms = weighed.groupBy("block").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("terms"))

    templates = spark.createDataFrame(TEMPLATES, "license string, kind string, body string")
    ttf = templates.select("license", "kind", F.explode(_terms("body")).alias("term")).groupBy("license", "kind", "term").agg(F.count("*").alias("tf"))
    tw = ttf.join(df, "term", "left").withColumn("tw", F.col("tf") * idf).select("license", "kind", "term", "tw")
    tnorm = tw.groupBy("license", "kind").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    tw = tw.join(F.broadcast(tnorm), ["license", "kind"])  # as many rows as the templates have terms
    dots = weighed.join(F.broadcast(tw), "term").groupBy("block", "license", "kind", "tnorm").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = dots.join(norms, "block").select("block", "license", "terms", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("score"))
    best = cosine.groupBy("block").agg(F.max("score").alias("score"), F.first("terms").alias("terms"), F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("license")).filter(F.col("score") >= least)
    # the matching lines of a file add up; of repeated rows (a line of one text k times) words add up as well
    copies = row.filter(_cued("text")).groupBy("path", F.xxhash64("text").alias("copy")).agg(F.count("*").alias("copies"))
    shares = lines.join(best, "block").groupBy("path", "copy", "words").agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("license"), F.sum("terms").alias("terms"))
    shares = shares.join(copies, ["path", "copy"]).withColumn("share", F.col("terms") / (F.col("words") * F.col("copies")))
    by_line = shares.groupBy("path").agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("license"), F.max("share").alias("share"))
    text = _held(row, held).select("path", *[F.col(c).alias(f"t_{c}") for c in ("license", "score", "share", "whole")])
    own = by_line.join(text, "path", "full")
    from_text = F.coalesce("t_whole", F.lit(False)) | F.col("license").isNull()
    own = own.select("path", *[F.when(from_text, F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in ("license", "score")], F.greatest("share", "t_share").alias("share"))
    own = scratch.write(own, "own")

    parts = F.split(F.coalesce("path", F.lit("")), "/")
    directory = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    own = own.withColumn("dir", directory)
    speaking = own.filter(F.col("share") >= file_share).groupBy("dir").agg(F.min_by("license", F.struct(-F.col("score"), F.col("path"))).alias("dir_license"), F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("dir_path"))
    placed = row.select("doc_id", "path", directory.alias("dir"))
    dirs = placed.select("dir").distinct()
    names = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(names))).alias("depth")).withColumn("anc", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("depth")), "/"))
    nearest = above.join(speaking.withColumnRenamed("dir", "anc"), "anc").groupBy("dir").agg(F.max_by("dir_license", "depth").alias("dir_license"), F.max_by("dir_path", "depth").alias("dir_path"))
    return placed.join(own.select(F.col("path"), "license", "score"), "path", "left").join(nearest, "dir", "left").select(
        "doc_id", "path", F.coalesce("license", "dir_license", F.lit("none")).alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("dir_path")).alias("origin_path"), "score")


def _sql_terms(column: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower({column}), '{WORD}'), lambda w: regexp_replace(w, '^[.+-]+|[.+-]+$', '', 'g')), lambda w: w <> '')"


def _sql_cued(column: str) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{cue}')" for cue in CUES) + ")"


_SQL_TEMPLATES = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in TEMPLATES)
#: The scan of ``documents`` with the path source/lang/doc_id.
ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, text FROM documents),
lines AS (SELECT * FROM (SELECT path, len({_sql_terms('text')}) AS words, unnest(string_split(text, chr(10))) AS block FROM docs WHERE {_sql_cued('text')}) WHERE {_sql_cued('block')}),
blocks AS (SELECT block, count(*) AS n FROM lines GROUP BY block),
total AS (SELECT coalesce(sum(n), 0) AS total FROM blocks),
tf AS (SELECT block, n, term, count(*) AS tf FROM (SELECT block, n, unnest({_sql_terms('block')}) AS term FROM blocks) GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM tf GROUP BY term),
w AS (SELECT block, term, tf, tf * (ln((1 + total) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), total),
norms AS (SELECT block, sqrt(sum(w * w)) AS norm, sum(tf) AS terms FROM w GROUP BY block),
templates(license, kind, body) AS (VALUES {_SQL_TEMPLATES}),
ttf AS (SELECT license, kind, term, count(*) AS tf FROM (SELECT license, kind, unnest({_sql_terms('body')}) AS term FROM templates) GROUP BY ALL),
tw AS (SELECT license, kind, term, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) AS tw FROM ttf LEFT JOIN df USING (term), total),
tnorm AS (SELECT license, kind, sqrt(sum(tw * tw)) AS tnorm FROM tw GROUP BY ALL),
cosine AS (SELECT block, license, any_value(terms) AS terms, round(sum(w * tw) / (any_value(norm) * any_value(tnorm)), 6) AS score FROM w JOIN tw USING (term) JOIN tnorm USING (license, kind) JOIN norms USING (block) GROUP BY block, license, kind),
best AS (SELECT block, any_value(terms) AS terms, max(score) AS score, first(license ORDER BY score DESC, license) AS license FROM cosine GROUP BY block HAVING max(score) >= 0.5),
own AS (SELECT path, max(score) AS score, first(license ORDER BY score DESC, license) AS license, max(terms / words) AS share, regexp_replace(path, '/[^/]*$', '') AS dir FROM lines JOIN best USING (block) GROUP BY path),
speaking AS (SELECT dir, first(license ORDER BY score DESC, path) AS dir_license, first(path ORDER BY score DESC, path) AS dir_path FROM own WHERE share >= 0.25 GROUP BY dir),
placed AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir FROM docs),
near AS (SELECT d.dir, first(dir_license ORDER BY length(s.dir) DESC) AS dir_license, first(dir_path ORDER BY length(s.dir) DESC) AS dir_path FROM (SELECT DISTINCT dir FROM placed) d JOIN speaking s ON s.dir = d.dir OR starts_with(d.dir, s.dir || '/') OR s.dir = '' GROUP BY d.dir)
SELECT doc_id, path, coalesce(license, dir_license, 'none') AS license, CASE WHEN license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN license IS NOT NULL THEN path ELSE dir_path END AS origin_path, score
FROM placed LEFT JOIN own USING (path) LEFT JOIN near ON near.dir = placed.dir
"""
