"""License scans by diagonal voting, in DataFrame operations only.

Every run of ``GRAM`` words of every document is hashed and joined to the positions
of the same hash in the license templates. A hit votes for the diagonal (document
position minus template position); the votes of a document and template are grouped
by diagonal, diagonals at most ``GAP`` apart are one span, and a span is verified by
the share of the template's positions that it covers, by its length, and by the words
that tell the template from its like, all of which it must hold. Of spans that overlap,
the one of the best share is the label's. Words are compared as well as hashes. Fixed
phrases give the base labels.

A document's words are split once. The join, a row for the document itself beside its
hits, is one pass over the texts; what is left is dealt by document once, and everything
after that stays where it is.

Words are runs of letters, digits and everything that isn't ASCII. Lower-casing is
Spark's; it changes no word boundary, and of ASCII letters it can only give a k (for
the Kelvin sign), which no phrase has.

Edge cases: null and empty texts have no words; texts of any length are read whole, and
one document's hits, which are few beside its words, are one task's; of overlapping spans
of one share the one of more words is taken, then the template that comes first; repeated
rows give a row each; null ids are kept; extra columns are ignored; no documents give no
rows; no templates leave the base labels.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 3
GAP = 2
COVERED = 0.6
#: Templates of up to so many positions are sent to every task; more are joined by a shuffle.
BROADCAST_POSITIONS = 100_000

# Phrases and their labels; and labels, notices and texts of public licenses, and words that tell them from others.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = [
    ("mit", "Released under the MIT License", "the mit license"),
    ("mit", "Licensed under the MIT License", "the mit license"),
    ("mit", "This project is licensed under the terms of the MIT license", "the mit license"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions', "deal in the"),
    ("apache", "Licensed under the Apache License, Version 2.0", "the apache license"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "the apache license"),
    ("apache", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache license version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu general public"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public"),
    ("gpl", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "gnu general public"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "gnu lesser general"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3", "gnu lesser general"),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "gnu lesser general"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu affero general"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3", "gnu affero general"),
    ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "gnu affero general"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "bsd style license"),
    ("bsd", "Licensed under the BSD 3-Clause License", "bsd 3 clause"),
    ("bsd", "Licensed under the BSD 2-Clause License", "bsd 2 clause"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "granted provided that"),
    ("isc", "Licensed under the ISC License", "the isc license"),
    ("0bsd", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS"', "granted the software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla public license"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "eclipse public license"),
    ("epl", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", "eclipse public license"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "redistribute it freely"),
    ("boost", "Distributed under the Boost Software License, Version 1.0.", "boost software license"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "and unencumbered software"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "has waived all"),
]
CC_PARTS = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
CC_KINDS = ("by", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def creative_commons() -> list[tuple[str, str, str]]:
    """Notices of every kind and version; the last part of a kind and the version's number tell it from the others."""
    out = []
    for kind in CC_KINDS:
        name = "-".join(CC_PARTS[p] for p in kind.split("-"))
        last = ["Creative", "Commons", *name.split("-")][-2:]
        short = ["cc", *kind.split("-")][-2:]
        for version in CC_VERSIONS:
            number = version.split(".")[0]
            legal = "International" if version == "4.0" else "Unported"
            out.append((f"cc-{kind}", f"This work is licensed under a Creative Commons {name} {version} {legal} License", " ".join([*last, number]).lower()))
            out.append((f"cc-{kind}", f"Licensed under CC {kind.upper()} {version}", " ".join([*short, number])))
        out.append((f"cc-{kind}", f"licensed under the Creative Commons {name} license", " ".join([*last, "license"]).lower()))
    return out


TEMPLATES = NOTICES + creative_commons()

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATOR), "")


def runs_of(words: str, size: int = GRAM) -> Column:
    """For each word, itself and the ``size - 1`` after it, as ``a0, a1`` and so on; null beyond the end."""
    return F.arrays_zip(F.col(words).alias("a0"), *[F.slice(words, j + 1, F.greatest(F.size(words), F.lit(1))).alias(f"a{j}") for j in range(1, size)])


def template_positions(spark: SparkSession, templates: list[tuple[str, str, str]] = TEMPLATES, size: int = GRAM) -> DataFrame:
    """``template, label, n_positions, t_words, must, t_pos, t_run, h`` of each position of each template; ``must`` are positions that tell it from its like."""
    kind = "array<struct<template:int,label:string,text:string,tells:string>>"
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(tells).alias("tells")) for i, (label, text, tells) in enumerate(templates)]
    one = spark.range(1).select(F.explode(F.array(*rows) if rows else F.expr(f"cast(array() as {kind})")).alias("t")).select("t.*")
    runs = one.withColumn("words", words_of(F.col("text"))).withColumn("runs", F.filter(runs_of("words", size), lambda x: x[f"a{size - 1}"].isNotNull()))
    told = F.concat_ws(" ", *[F.col("x")[f"a{j}"] for j in range(size)])
    every = runs.select("template", "label", F.size("runs").alias("n_positions"), F.size("words").alias("t_words"), "tells", F.posexplode("runs").alias("t_pos", "x")).withColumn("told", told == F.col("tells"))
    must = every.groupBy("template").agg(F.collect_set(F.when(F.col("told"), F.col("t_pos"))).alias("must"))
    return every.join(F.broadcast(must), "template").select("template", "label", "n_positions", "t_words", "must", "t_pos", F.col("x").alias("t_run"), F.xxhash64(*[f"x.a{j}" for j in range(size)]).alias("h"))  # a row a template


def hits(docs: DataFrame, carried: list[str], templates: list[tuple[str, str, str]], size: int) -> DataFrame:
    """Of documents with ``rid`` and ``words``: a row for each document, with the ``carried`` columns as ``doc``, and one for each hit; dealt by ``rid``."""
    positions = template_positions(docs.sparkSession, templates, size)
    if sum(len(re.findall(r"\w+", t[1])) for t in templates) <= BROADCAST_POSITIONS:
        positions = F.broadcast(positions)
    runs = docs.select("rid", *carried, F.posexplode_outer(runs_of("words", size)).alias("pos", "run"))
    runs = runs.withColumn("h", F.when(F.col(f"run.a{size - 1}").isNotNull(), F.xxhash64(*[f"run.a{j}" for j in range(size)])))
    same = F.lit(True)
    for j in range(size):
        same = same & (F.col(f"run.a{j}") == F.col(f"t_run.a{j}"))
    itself = F.coalesce(F.col("pos"), F.lit(0)) == 0
    joined = runs.join(positions, "h", "left").where(same | itself)
    hit = lambda c: F.when(same, F.col(c)).alias(c)
    out = joined.select("rid", F.when(itself, F.struct(*carried)).alias("doc"), *map(hit, ("pos", "template", "label", "n_positions", "t_words", "must", "t_pos")))
    return out.repartition("rid")


def spans(found: DataFrame, size: int = GRAM, gap: int = GAP, covered: float = COVERED) -> DataFrame:
    """Spans of templates in documents: where they are, their share of the template, and whether they hold; and the documents' own rows."""
    first = [F.first(c).alias(c) for c in ("label", "n_positions", "t_words", "must")]
    votes = found.groupBy("rid", "template", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.min("pos").alias("begin"), F.max("pos").alias("end"), F.collect_set("t_pos").alias("at"), F.first("doc", ignorenulls=True).alias("doc"), *first
    )
    along = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along), F.lit(0)) > gap).cast("int")
    merged = votes.withColumn("apart", apart).withColumn("run", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    out = merged.groupBy("rid", "template", "run").agg(
        F.min("begin").alias("begin"), (F.max("end") + size).alias("end"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.first("doc", ignorenulls=True).alias("doc"), *first
    )
    share = F.size("at") / F.col("n_positions")
    told = F.size(F.array_except("must", "at")) == 0
    holds = told & (share >= covered) & (F.col("end") - F.col("begin") <= 2 * F.col("t_words"))
    return out.select("rid", "doc", "template", "label", "begin", "end", F.size("at").alias("covers"), F.when(F.col("template").isNotNull() & told, share).alias("share"), F.coalesce(holds & F.col("template").isNotNull(), F.lit(False)).alias("holds"))


def winners(found: DataFrame) -> DataFrame:
    """For each run of overlapping spans that hold, the label of the best; with the documents' own rows and the best share of any."""
    order = Window.partitionBy("rid").orderBy(F.col("begin").asc_nulls_first(), "template")
    held = F.when(F.col("holds"), F.col("end"))
    before = F.max(held).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("holds") & (F.col("begin") >= F.coalesce(before, F.lit(0)))).cast("int")
    marked = found.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.when(F.col("holds"), F.struct("share", "covers", -F.col("template"), "label")))
    return marked.groupBy("rid", "island").agg(best["label"].alias("label"), F.max("share").alias("share"), F.first("doc", ignorenulls=True).alias("doc"))


def base_columns(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, words`` with the places and labels of the phrases."""
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    has = {p: F.contains("line", F.lit(f" {p} ")) for p in PHRASES}
    labels = F.array_sort(F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in PHRASES.items()])))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    some = docs.withColumn("line", line).withColumn("base", labels)
    parts = F.when(F.size("base") > 0, F.split("line", " (?=(?:" + "|".join(PHRASES) + ") )"))  # no other line is searched
    n_words = F.size("words").cast("long")
    return some.withColumn("parts", parts).select(
        "rid",
        "doc_id",
        "words",
        n_words.alias("n_words"),
        F.coalesce(F.size("parts") - 1, F.lit(0)).cast("long").alias("n_base"),
        spaces(F.element_at("parts", 1)).cast("long").alias("first_word"),
        (n_words - spaces(F.element_at("parts", -1))).cast("long").alias("last_word"),
        "base",
    )


BASE = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, size: int = GRAM, gap: int = GAP, covered: float = COVERED) -> DataFrame:
    """A row for each document: words, places of the phrases, labels of phrases and of both, and the best template's share."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    found = winners(spans(hits(base_columns(rows), BASE, templates, size), size, gap, covered))
    out = found.groupBy("rid").agg(F.first("doc", ignorenulls=True).alias("doc"), F.collect_set("label").alias("more"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    every = F.array_sort(F.array_union("doc.base", "more"))
    return out.select(*[f"doc.{c}" for c in BASE[:-1]], F.array_join("doc.base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), "score")


def oracle_sql(templates: list[tuple[str, str, str]] = TEMPLATES, size: int = GRAM, gap: int = GAP, covered: float = COVERED) -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(label)}, {quoted(text)}, {quoted(tells)})" for i, (label, text, tells) in enumerate(templates))
    phrases = "|".join(PHRASES)
    case = ", ".join(f"CASE WHEN contains(line, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
    grams = f"list_transform(range(0, len(words) - {size} + 1), lambda i: array_to_string(words[i + 1 : i + {size}], ' '))"
    words = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH t0(template, label, text, tells) AS (VALUES {values}),
t1 AS (SELECT template, label, tells, {words("text")} AS words FROM t0),
t2 AS (SELECT template, label, tells, len(words) AS t_words, len(words) - {size} + 1 AS n_positions, unnest(range(0, len(words) - {size} + 1)) AS t_pos, unnest({grams}) AS gram FROM t1),
t AS (SELECT *, coalesce(list(t_pos) FILTER (gram = tells) OVER (PARTITION BY template), []) AS must FROM t2),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS words FROM documents),
g AS (SELECT rid, unnest(range(0, len(words) - {size} + 1)) AS pos, unnest({grams}) AS gram FROM d),
v AS (SELECT rid, template, pos - t_pos AS diagonal, min(pos) AS b, max(pos) AS e, list(t_pos) AS seen, any_value(label) AS label, any_value(n_positions) AS n_positions, any_value(t_words) AS t_words, any_value(must) AS must
      FROM g JOIN t USING (gram) GROUP BY rid, template, pos - t_pos),
w AS (SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal), 0) > {gap} THEN 1 ELSE 0 END AS apart FROM v),
r AS (SELECT *, sum(apart) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM w),
m AS (SELECT rid, template, run, min(b) AS b, max(e) + {size} AS e, list_distinct(flatten(list(seen))) AS seen, any_value(label) AS label, any_value(n_positions) AS n_positions, any_value(t_words) AS t_words, any_value(must) AS must FROM r GROUP BY rid, template, run),
s AS (SELECT rid, template, label, b, e, len(seen) AS covers, len(seen) / n_positions AS share FROM m WHERE list_has_all(seen, must)),
h0 AS (SELECT s.*, max(e) OVER (PARTITION BY rid ORDER BY b, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s JOIN (SELECT template, any_value(t_words) AS t_words FROM t GROUP BY template) USING (template) WHERE share >= {covered} AND e - b <= 2 * t_words),
h1 AS (SELECT *, sum(CASE WHEN b >= coalesce(before, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY b, template) AS island FROM h0),
h AS (SELECT rid, label FROM h1 QUALIFY row_number() OVER (PARTITION BY rid, island ORDER BY share DESC, covers DESC, template) = 1),
l AS (SELECT rid, list(DISTINCT label) AS more FROM h GROUP BY rid),
x AS (SELECT rid, max(share) AS share FROM s GROUP BY rid),
b0 AS (SELECT rid, doc_id, len(words) AS n_words, ' ' || array_to_string(words, ' ') || ' ' AS line, words FROM d),
p AS (SELECT *, list_filter(range(0, n_words), lambda i: regexp_matches(array_to_string(words[i + 1 : i + 4], ' ') || ' ', '^({phrases}) ')) AS places, list_filter([{case}], lambda x: x IS NOT NULL) AS base FROM b0)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels, coalesce(share, 0.0)::DOUBLE AS score
FROM p LEFT JOIN l USING (rid) LEFT JOIN x USING (rid)"""
