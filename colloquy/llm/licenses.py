"""License scan: TF-IDF cosine of notices and licence files to templates, and inheritance from the nearest directory.

DataFrame functions only.
"""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.llm.common import saved

# Notices and opening sentences of public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is free software: licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
)
#: A notice has one of these; a segment without any of them is none.
CUES = ("licen", "copyright", "permission", "redistribut", "public domain", "spdx")
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Least cosine of a notice, and of a whole file that counts as a licence file of its directory.
HEADER, FILE = 0.6, 0.5


def _has_cue(lower: Column) -> Column:
    found = F.lit(False)
    for cue in CUES:
        found = found | F.contains(lower, F.lit(cue))
    return found


def _terms(lower: Column) -> Column:
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


def template_terms(spark: SparkSession) -> DataFrame:
    """(template, license, term, tf) of all templates: a table whose size the program text fixes."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(n).alias("license"), F.lit(t).alias("text")) for i, (n, t) in enumerate(TEMPLATES)])
    return (spark.range(1).select(F.explode(rows).alias("r")).select("r.template", "r.license", F.explode(_terms(F.lower("r.text"))).alias("term"))
            .groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf")))


def own_licenses(files: DataFrame) -> DataFrame:
    """(path, license, origin, score) of files (path, text) that carry a notice or are a licence file.

    Every whole text is cut at line and sentence ends; segments with a cue are units, and so is the whole text of a
    file with such a segment. Document frequencies of template terms are counted over all segments of all files, other
    terms count as seen in none. A unit's licence is the template of the highest cosine. A file is a licence file if its whole text
    reaches FILE, else its best segment decides if it reaches HEADER. Only texts with a cue are shuffled, as terms.
    """
    spark = files.sparkSession
    lower = F.lower("text")
    cued = files.where(_has_cue(lower)).select("path", lower.alias("text"))
    cut = F.filter(F.split(F.regexp_replace("text", r"([.!?;])\s+", "$1\n"), "\n"), _has_cue)
    units = cued.select("path", F.posexplode(F.concat(F.array("text"), cut)).alias("unit", "segment"))
    tf = saved(units.select("path", "unit", F.explode(_terms(F.col("segment"))).alias("term"))
               .groupBy("path", "unit", "term").agg(F.count(F.lit(1)).alias("n")))
    templates = template_terms(spark)
    vocabulary = F.broadcast(templates.select("term").distinct())
    total = tf.where("unit > 0").select("path", "unit").distinct().agg(F.count(F.lit(1)).alias("units"))
    df = tf.where("unit > 0").join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = templates.select("term").distinct().join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    rarity = lambda d: F.log((F.lit(1.0) + total.scalar()) / (F.lit(1.0) + d)) + 1.0
    idf = known.select("term", rarity(F.col("df")).alias("idf"))
    vectors = templates.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = vectors.join(norms, "template").select("template", "license", "term", (F.col("w") / F.col("norm")).alias("w"), "idf")
    weighted = tf.join(F.broadcast(idf), "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", rarity(F.lit(0.0))))
    lengths = weighted.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dots = (tf.join(F.broadcast(vectors), "term").groupBy("path", "unit", "template", "license")
            .agg(F.sum(F.col("n") * F.col("idf") * F.col("w")).alias("dot")))
    scored = dots.join(lengths, ["path", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("length"), 6))
    whole = (F.col("unit") == 0) & (F.col("score") >= FILE)
    noted = (F.col("unit") > 0) & (F.col("score") >= HEADER)
    best = scored.where(whole | noted).groupBy("path").agg(F.max(F.struct((F.col("unit") == 0).alias("whole"), "score", (-F.col("template")).alias("t"), "license")).alias("b"))
    return best.select("path", "b.license", F.when(F.col("b.whole"), "file").otherwise("header").alias("origin"), "b.score")


def license_scan(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, license, origin, score, licensed_by) per row: a file's own licence, else that of the nearest ancestor directory.

    Paths are cut at "/". A directory has the licence of its licence file of the highest score (ties: smallest
    path). A file without licence takes that of the nearest directory above it that has one: directories are joined to
    their ancestors by equality, files to their directory. Null texts carry nothing; a null path is an empty one, which lies in the root directory
    "". Rows of equal path are one file with all their texts, each returned. No licence found: nulls. Directories never
    meet all files, so a directory with very many files is one join key that Spark splits.
    """
    base = files.select(F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(text).alias("text"))
    own = saved(own_licenses(base))
    folder = lambda p: F.regexp_replace(p, r"(^|/)[^/]*$", "")
    given = (own.where("origin = 'file'").groupBy(folder(F.col("path")).alias("folder"))
             .agg(F.min_by(F.struct("license", "path"), F.struct(-F.col("score"), F.col("path"))).alias("g")))
    folders = base.select(folder(F.col("path")).alias("home")).distinct()
    parts = F.split("home", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("home") == "", 0).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # as a table of its own the directories can be broadcast if they are few, and a large join can be split
    inherited = saved(folders.select("home", F.explode(above).alias("folder")).join(given, "folder")
                      .groupBy("home").agg(F.max_by("g", F.length("folder")).alias("g")))
    rows = (base.select("path", folder(F.col("path")).alias("home")).join(own, "path", "left").join(inherited, "home", "left"))
    return rows.select("path", F.coalesce("license", "g.license").alias("license"),
                       F.when(F.col("license").isNotNull(), F.col("origin")).when(F.col("g").isNotNull(), "inherited").alias("origin"),
                       "score", F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("g.path")).alias("licensed_by"))
