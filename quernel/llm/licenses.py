"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance by directory.

Files have a path and a text. Candidate passages (lines, sentences and runs of words around each cue word, also where they
are wrapped over lines; see passages_of) and whole licence files become sparse TF-IDF vectors over template terms only, and meet the templates in an equi-join on terms. A file without a licence
of its own takes that of the licence file in its nearest ancestor directory: each path is joined with its own prefixes, so
there is no search up a tree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed list of short licence notices by SPDX identifier: usual header lines, as templates.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction. MIT License"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2"],
    "Artistic-2.0": ["Released under the Artistic License 2.0"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "GPL-2.0-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1-or-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0-or-later": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "LicenseRef-proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}
#: The opening of each licence's full text, and its usual names. Whole texts are found by their openings.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "Apache License, Version 2.0"],
    "MIT": ["MIT License", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "GPL-3.0-only": ["GNU General Public License Version 3, 29 June 2007"],
    "GPL-2.0-only": ["GNU General Public License Version 2, June 1991"],
    "LGPL-2.1-only": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL-3.0-only": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "AGPL-3.0-only": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "Unlicense": ["The Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International"],
}
#: Names of licences as notices give them, made into "Licensed under the ..." with the version in both usual spellings.
NOTICES: dict[str, tuple[str, str]] = {
    "Apache-2.0": ("Apache License", "2.0"),
    "GPL-2.0-only": ("GNU General Public License", "2"),
    "GPL-3.0-only": ("GNU General Public License", "3"),
    "LGPL-2.1-only": ("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0-only": ("GNU Lesser General Public License", "3"),
    "AGPL-3.0-only": ("GNU Affero General Public License", "3"),
    "MPL-2.0": ("Mozilla Public License", "2.0"),
    "EPL-2.0": ("Eclipse Public License", "2.0"),
    "BSL-1.0": ("Boost Software License", "1.0"),
    "EUPL-1.2": ("European Union Public Licence", "1.2"),
    "Artistic-2.0": ("Artistic License", "2.0"),
}
#: Identifiers whose SPDX tag is a template.
TAGS = sorted({*TEMPLATES, *NAMES, "GPL-3.0-only", "GPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only"} - {"LicenseRef-proprietary"})
ALL = [(s, t) for ts in (TEMPLATES, NAMES, {s: [f"Licensed under the {n}, version {v}", f"Licensed under the {n} v{v}"] for s, (n, v) in NOTICES.items()}, {s: [f"SPDX-License-Identifier: {s}"] for s in TAGS}) for s, x in ts.items() for t in x]
#: A line with one of these may belong to a licence.
CUE = r"(?i)licen[sc]e|copyright|all rights reserved|redistribut|spdx|creative commons|permission is hereby granted|hereby granted|public domain|permission to use|free software"
#: An SPDX tag up to its identifier; tags are passages of their own, as all tags have most words in common.
TAG = r"(?i)SPDX-License-Identifier:?[ \t]*"
#: Names of files that speak for their directory.
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][a-z0-9.-]*)?$"
COLUMNS = ["path", "license", "score", "origin", "inherited_from"]


def terms(text: Column) -> Column:
    """Lower-case words and numbers, with their neighbours as pairs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[0-9]+(?:\.[0-9]+)*"), F.lit(0))
    return F.transform(F.array(words), lambda w: F.concat(w, F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))))[0]


def templates(spark: SparkSession) -> DataFrame:
    """template, license, term, weight: normalised TF-IDF of each template; a fixed table of a few hundred rows."""
    rows = spark.createDataFrame([(i, spdx, t) for i, (spdx, t) in enumerate(ALL)], "template int, license string, text string")
    n = len(ALL)
    tf = rows.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg((F.log(F.lit(1.0 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    return raw.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))).select("template", "license", "term", "idf", (F.col("w") / F.col("norm")).alias("weight"))


def passages_of(text: Column) -> Column:
    """The candidate passages of a text: each line with a cue, alone and with its neighbour; each sentence with a cue from 3
    lines before to 8 after it (wrapped lines are joined, blank ones end a sentence), alone and with neighbours; the words
    before and after a cue; SPDX tags. A window chooses what is compared and drops nothing from the other windows."""
    at = lambda x, i: F.get(x, i)
    near = lambda x, i, before, after: F.array_join(F.slice(x, F.greatest(i + 1 - before, F.lit(1)), before + 1 + after), "\n")
    cued = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: at(x, i).rlike(CUE))
    words = lambda line, before, after: F.regexp_extract_all(line, F.lit(rf"(?:\S+\s+){{0,{before}}}\S*(?:{CUE})\S*(?:\s+\S+){{0,{after}}}"), F.lit(0))

    def around(lines: Column, i: Column) -> Column:
        sentences = F.split(near(lines, i, 3, 8), r"(?<=[.;!?])\s+|\n[^a-zA-Z0-9\n]*(?=\n)")
        runs = F.transform(F.array(sentences), lambda s: F.flatten(F.transform(cued(s), lambda j: F.array(at(s, j), near(s, j, 0, 1), near(s, j, 1, 0), near(s, j, 0, 2), near(s, j, 1, 1)))))[0]
        line = at(lines, i)
        return F.concat(F.array(line, near(lines, i, 0, 1), near(lines, i, 1, 0)), runs, words(line, 4, 0), words(line, 0, 4), words(line, 0, 6))

    # The text is cut into lines once, and only texts with a cue are looked at more closely.
    close = F.transform(F.array(F.split(F.regexp_replace(text, rf"{TAG}[A-Za-z0-9.+-]*", " "), "\n")), lambda x: F.flatten(F.transform(cued(x), lambda i: around(x, i))))[0]
    tags = F.regexp_extract_all(text, F.lit(rf"{TAG}[A-Za-z0-9.+-]+"), F.lit(0))
    return F.when(text.rlike(CUE), F.array_distinct(F.concat(tags, close))).otherwise(F.array().cast("array<string>"))


def scan(files: DataFrame, scratch: Scratch, threshold: float = 0.6, path: str = "path", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """path, license, score, origin (header, file, inherited or none), inherited_from and the carried columns of every row.

    Passages are those of passages_of, whole licence files besides. Reserved rights count only where no licence is found,
    as most notices of a licence reserve them first. A term no template has counts for the passage's
    length with the weight of a term in no template. Null and empty texts have no licence of their own and may inherit; a
    null path has no ancestors; texts are whole, however long; repeated rows give repeated results. Ties go to the better score,
    then the smaller identifier. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = files.sparkSession
    is_file = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    carried = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`") for c in carry))
    rows = files.select(F.col(path).cast("string").alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), carried.alias("carried"), F.monotonically_increasing_id().alias("row"))
    passages = F.array_distinct(F.concat(passages_of(F.col("text")), F.when(is_file, F.array("text")).otherwise(F.array().cast("array<string>"))))
    # Texts are read once: what is written has no text but the passages, and few rows have any.
    seen = scratch.keep(rows.select("row", "path", is_file.alias("is_file"), "carried", passages.alias("passages")))
    each = seen.where(F.size("passages") > 0).select("row", "path", "is_file", "carried", F.explode("passages").alias("passage"))
    known = templates(spark)
    vocabulary = known.select("term", "idf").distinct()
    unseen = 1.0 + math.log(1.0 + len(ALL))
    # Equal passages are looked at once.
    # The explode is an outer one, as for an inner one Spark would make the terms a second time to test their number.
    tf = each.select("passage").distinct().select("passage", F.explode_outer(terms(F.col("passage"))).alias("term")).where("term is not null").groupBy("passage", "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(F.broadcast(vocabulary), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = weighed.groupBy("passage").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.where("idf is not null").join(F.broadcast(known.select("template", "license", "term", "weight")), "term").groupBy("passage", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "passage").withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
    # Tables that are joined with one row for each key are written first: both sides of the join are plain exchanges then, and
    # Spark can split the rows of a frequent passage or a large folder.
    best = scratch.keep(scored.groupBy("passage").agg(F.max_by(F.struct("license", "score"), F.struct("score", -F.col("template"))).alias("m")).select("passage", "m.license", "m.score"))
    # Each row takes the best of its passages; rows without one keep out of the join.
    mine = each.join(best, "passage").groupBy("row").agg(F.max(F.struct((F.col("license") != "LicenseRef-proprietary").alias("named"), "score", "license")).alias("m"), F.first("path").alias("path"), F.first("is_file").alias("is_file"), F.first("carried").alias("carried"))
    own = scratch.keep(mine.select("row", "path", "is_file", "carried", "m.license", "m.score"))
    bare = scratch.keep(seen.join(own.select("row"), "row", "left_anti").select("path", "carried"))
    # Directories that a licence file speaks for, one row each, meet the ancestors of directories with files without a licence.
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    speaks = scratch.keep(own.where("is_file").groupBy(folder.alias("dir")).agg(F.max(F.struct("score", "license", "path")).alias("f")).select("dir", "f.license", "f.score", F.col("f.path").alias("inherited_from")))
    homes = bare.where("path is not null").select(folder.alias("home")).distinct()
    above = homes.select("home", F.explode(F.transform(F.array(F.split("home", "/")), lambda p: F.transform(F.sequence(F.lit(0), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/")))[0]).alias("dir"))
    nearest = scratch.keep(above.join(speaks, "dir").groupBy("home").agg(F.max_by(F.struct("license", "score", "inherited_from"), F.length("dir")).alias("n")).select("home", "n.*"))
    heirs = bare.withColumn("home", folder).join(nearest, "home", "left").select("path", "license", "score", F.when(F.col("license").isNotNull(), "inherited").otherwise("none").alias("origin"), "inherited_from", "carried")
    direct = own.select("path", "license", "score", F.when(F.col("is_file"), "file").otherwise("header").alias("origin"), F.lit(None).cast("string").alias("inherited_from"), "carried")
    return direct.unionByName(heirs).select(*COLUMNS, *(F.col("carried").getField(c).alias(c) for c in carry))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """path, text: a document lies at source/lang/doc_id; one whose every line with a word has a cue is its folder's LICENSE file."""
    filled = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    whole = (F.size(filled) > 0) & F.forall(filled, lambda x: x.rlike(CUE))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.when(whole, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt")))).alias("path"), "text")
