"""Licence scans in DataFrame functions only.

Licence lines, header blocks and licence files are compared with templates by the cosine of sparse TF-IDF vectors. Lines
are scored alone; blocks are joined across their line breaks, without comment marks, and scored by spans. Each distinct
line or span is scored once, however many files carry it. A file without a licence of its own takes that of the nearest
directory above it that has a licence file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

# Names of licences and wordings by which texts declare them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, all copyright and related rights are waived. Dedicated to the public domain, CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LGPL-2.1", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
CUE = r"(?i)licen[sc]e|permission is hereby|redistribut|spdx-|public domain|copyright"
LICENCE_NAME = r"(?i)^(licen[sc]e|copying|notice|unlicense)(\..*)?$"
COSINE = 0.7
# What a span has to hold besides its cosine, so that prose about another licence or version is not taken for this one.
NAMED = {
    "Apache-2.0": r"apache.*2\.0",
    "MIT": r"(^| )mit( |$)|permission is hereby granted|this permission notice",
    "GPL-3.0": r"(gpl|gnu general public).*3",
    "BSD-3-Clause": r"bsd|redistribution and use in source",
    "CC-BY-4.0": r"(cc by|creative commons attribution|cc-by) ?-?4\.0",
    "CC-BY-NC-4.0": r"by-nc.4\.0",
    "CC-BY-SA-4.0": r"by-sa.4\.0",
    "CC0-1.0": r"cc0|public domain|related rights are waived",
    "MPL-2.0": r"(mpl|mozilla public).*2\.0",
    "LGPL-2.1": r"(lgpl|lesser general public).*2\.1",
}
BLOCK_CUE = CUE + "|permission"  # "permission is hereby" may be broken between lines
MARKS = r"""(?m)^[ \t]*(?:#+|//+!?|/?\*+/?|--+|;+|%+|<!--+|\"{3}|'{3})[ \t]*"""
STRETCH = (1.0, 1.5, 2.0)


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}.+-]+|\.(?=\s|$)|(?<=\s)\.", -1), lambda w: w != "")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, license string, wording string")


def words_of(wording: str) -> list[str]:
    """``terms`` of a template, on the driver."""
    return [w for w in re.split(r"[^\w.+-]+|\.(?=\s|$)|(?<=\s)\.", wording.lower()) if w]


def spans(known: list[tuple[str, str]]) -> Column:
    """The distinct spans of the array ``w`` that begin or end like a template, are 1 to 2 times as long and hold half of its words, those with a cue."""
    places, none = F.sequence(F.lit(1), F.size("w")), F.expr("cast(array() as array<int>)")

    def cut(words: list[str], n: int) -> Column:
        first, last, held = words[0], words[-1], F.array(*[F.lit(x) for x in sorted(set(words))])
        begin = F.filter(places, lambda i: F.element_at("w", i) == first)
        end = F.transform(F.filter(places, lambda i: (F.element_at("w", i) == last) & (i >= n)), lambda i: i - (n - 1))
        starts = F.when(F.array_contains("w", first) | F.array_contains("w", last), F.array_union(begin, end)).otherwise(none)
        full = F.filter(F.transform(starts, lambda i: F.slice("w", i, n)), lambda x: F.size(F.array_intersect(x, held)) * 2 >= len(set(words)))
        return F.transform(full, lambda x: F.array_join(x, " "))

    each = [cut(w, int(len(w) * x)) for w in (words_of(t) for _, t in known) for x in STRETCH]
    return F.filter(F.array_distinct(F.flatten(F.array(*each))), lambda x: x.rlike(CUE))


def score_lines(lines: DataFrame, known: DataFrame, counted_in: DataFrame | None = None) -> DataFrame:
    """Rows ``(line, license, cosine)``: the best template of each distinct line, for cosines of COSINE or more; ties go to the first template.

    A term's weight is (1 + ln tf) * (1 + ln((1 + N) / (1 + df))) over the N distinct lines and the templates together,
    or over those of ``counted_in`` and the templates.
    """
    split = lambda d: d.select("line", F.explode(terms(F.col("line"))).alias("term"))
    lines = lines.select("line").where("line is not null").distinct()
    basis = lines if counted_in is None else counted_in.select("line").where("line is not null").distinct()
    counted = split(lines).groupBy("line", "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    asked = known.select("template", F.explode(terms(F.col("wording"))).alias("term")).groupBy("template", "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    total = basis.agg(F.count("*").alias("n")).crossJoin(known.agg(F.count("*").alias("k"))).select((F.col("n") + F.col("k")).alias("total"))  # one row
    seen = counted.select("term") if counted_in is None else split(basis).distinct().select("term")
    df = seen.unionByName(asked.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(total)).select("term", (1 + F.log((1 + F.col("total")) / (1 + F.col("df")))).alias("idf"))
    unseen = total.select((1 + F.log(1 + F.col("total"))).alias("unseen"))  # terms that only spans have
    weigh = lambda d: d.join(idf, "term", "left").crossJoin(F.broadcast(unseen)).withColumn("w", F.col("tf") * F.coalesce("idf", "unseen"))
    own, theirs = weigh(counted), weigh(asked)
    # Lengths over all terms; products only over those that a template has.
    norms = own.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    tnorms = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("tnorm"))
    vocabulary = F.broadcast(theirs.select("term", "template", F.col("w").alias("tw")))  # the templates are a fixed list
    dots = own.join(vocabulary, "term").groupBy("line", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    got = dots.join(norms, "line").join(F.broadcast(tnorms), "template").withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 9))
    best = got.groupBy("line").agg(F.max(F.struct("cosine", (-F.col("template")).alias("back"))).alias("b"))
    best = best.where(F.col("b.cosine") >= COSINE).select("line", (-F.col("b.back")).alias("template"), F.col("b.cosine").alias("cosine"))
    return best.join(F.broadcast(known.select("template", "license")), "template").select("line", "license", "cosine")


def scan(files: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows ``(key, path, license, cosine, origin)`` for ``files(key, path, text)``, one for each file.

    ``origin`` is *own* (a licence line, header block or file text), *inherited* (from the nearest directory above with a licence
    file) or *none*. A licence file is one named so, or one in which lines or spans of licences make up half of the text.
    A block is a paragraph with a cue, and the whole text of a file named as a licence.
    Of several licences in a file the best cosine counts, then the first name. Null and empty texts have no licence of
    their own; a null path has no directory.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.when(text.rlike(CUE), F.filter(F.transform(F.split(text, r"[\r\n]+", -1), F.trim), lambda x: x.rlike(CUE))).otherwise(F.expr("cast(array() as array<string>)"))
    base = F.element_at(F.split(F.coalesce("path", F.lit("")), "/", -1), -1)
    clean = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), MARKS, "")
    named = F.coalesce(base.rlike(LICENCE_NAME), F.lit(False))
    whole = F.when(named, F.array(clean)).otherwise(F.expr("cast(array() as array<string>)"))
    blocks = F.when(text.rlike(BLOCK_CUE), F.array_union(F.filter(F.split(clean, r"\n\s*\n", -1), lambda x: x.rlike(BLOCK_CUE)), whole)).otherwise(F.expr("cast(array() as array<string>)"))
    own = files.select(key, "path", lines.alias("lines"), blocks.alias("blocks"), F.length(F.trim(text)).alias("size"), named.alias("named"))
    own = materialize(own, "lic")
    told = own.where("size(lines) > 0").select(key, "path", "size", "named", F.explode("lines").alias("line"))
    scored = materialize(score_lines(told, known), "licline")
    cut = own.where("size(blocks) > 0").select(key, "path", "size", "named", F.posexplode("blocks").alias("block", "text"))
    cut = cut.withColumn("w", terms(F.col("text"))).drop("text").where("size(w) > 0")
    cut = materialize(cut.select(key, "path", "size", "named", "block", F.explode(spans([(r.license, r.wording) for r in known.collect()])).alias("line")), "licspan")  # a fixed list
    told_by = F.element_at(F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv]), F.col("license"))
    fit = materialize(score_lines(cut, known, told).where(F.coalesce(F.rlike("line", told_by), F.lit(True))), "licfit")
    best = F.max(F.struct("cosine", F.col("license"))).alias("b")
    by_line = told.join(scored, "line").groupBy(key, "path", "size", "named").agg(best, F.sum(F.length("line")).alias("covered"))
    by_span = cut.join(fit, "line").groupBy(key, "path", "size", "named", "block").agg(best, F.max_by(F.length("line"), F.struct("cosine", F.length("line"))).alias("long"))
    by_span = by_span.groupBy(key, "path", "size", "named").agg(F.max("b").alias("b"), F.sum("long").alias("covered"))
    hits = by_line.unionByName(by_span).groupBy(key, "path", "size", "named").agg(F.max("b").alias("b"), F.max("covered").alias("covered"))
    hits = hits.select(key, "path", F.col("b.license").alias("license"), F.col("b.cosine").alias("cosine"), (F.col("named") | (F.col("covered") * 2 >= F.col("size"))).alias("rules"))
    hits = materialize(hits, "lichit")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rules = hits.where("rules and path is not null").groupBy(folder.alias("folder")).agg(F.max(F.struct("cosine", "license")).alias("r"))
    rest = own.select(key, "path").join(hits.select(key, "path"), key, "left_anti")
    # Every directory above the file, nearest last: a path join for each level, and the deepest match wins.
    parts = F.split(folder, "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("folder")))
    climbed = rest.where("path is not null").select(key, "path", F.explode(above).alias("u")).select(key, "path", "u.depth", "u.folder")
    near = climbed.join(rules, "folder").groupBy(key).agg(F.max(F.struct("depth", "r")).alias("n"))
    inherited = rest.join(near, key, "left").select(key, "path", F.col("n.r.license").alias("license"), F.col("n.r.cosine").alias("cosine"), F.when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("origin"))
    return hits.select(key, "path", "license", "cosine", F.lit("own").alias("origin")).unionByName(inherited)


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, as files ``source/thousands of the id/id``: a document that is little but a licence rules its directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text"), templates(spark))
