"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

For templates of T words a text is cut into windows of 2 T words, one every T words, so that any
T words in a row lie within one. Template and window are sets of five-word shingles. The bands (of
one MinHash each) are as many as make a window that holds MATCH of a template's shingles share a
band with it with a probability of at least 1 - MISS; templates so retrieved match if the window
holds at least MATCH of their shingles, counted exactly. Templates may be of any length: beside the
notices below, :func:`read_templates` takes whole texts of licenses from a folder, and
:func:`clues_for` finds the clue words that they need.

Only texts and windows that hold one of the clue words are hashed: no window without one can hold
MATCH of any template's shingles, which :func:`clues_suffice` states and a test checks.

Rows: null text has no words and no license; repeated rows are returned each time, null ids are
kept, and texts are read whole. Each row is worked on by itself, without a shuffle.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, MATCH, MISS = 5, 0.8, 1e-6
#: Notices as they stand in files, by license.
TEMPLATES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-2-Clause", "in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-1.0", "made available under the terms of the Eclipse Public License v1.0"),
    ("EPL-1.0", "Eclipse Public License - v 1.0 THE ACCOMPANYING PROGRAM"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License v. 2.0"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License v2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License"),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License"),
    ("GPL-3.0", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.0", "under the terms of the GNU Library General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("LGPL-2.0", "under the terms of the GNU Library General Public License as published by the Free Software Foundation, version 2 of the License"),
    ("LGPL-2.0", "under the terms of the GNU Library General Public License version 2 as published by the Free Software Foundation"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 2.1 of the License"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3 of the License"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License version 3 as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Words of which every match holds one.
CLUES = ["cc0", "distribute", "documentation", "granted", "license", "licensed", "modification", "neighboring", "unencumbered"]
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOUND = "array<struct<license:string,template:int,containment:double,word:int>>"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_SEPARATORS, text.lower()) if w]


def shingles_of(words: list[str]) -> list[str]:
    """Distinct shingles, in order; fewer words make one."""
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))))


def bands_for(length: int) -> int:
    """Bands for templates of so many words: the lowest Jaccard similarity of a match decides."""
    own, window = max(1, length - SHINGLE + 1), max(1, 2 * length - SHINGLE + 1)
    shared = math.ceil(MATCH * own)
    return math.ceil(math.log(MISS) / math.log(1 - shared / (window + own - shared)))


def clues_suffice(templates=None, clues=None) -> bool:
    """Whether every template keeps too few shingles for a match without the clue words."""
    for _, text in templates or TEMPLATES:
        own = shingles_of(words_of(text))
        if sum(not set(s.split()) & set(clues or CLUES) for s in own) >= math.ceil(MATCH * len(own)):
            return False
    return True


def clues_for(templates: list[tuple[str, str]]) -> list[str]:
    """Words without which no template can match, those in most shingles first."""
    out: list[str] = []
    for _, text in templates:
        own = [set(x.split()) for x in shingles_of(words_of(text))]
        left = [x for x in own if not x & set(out)]
        while len(left) >= math.ceil(MATCH * len(own)):
            counts: dict[str, int] = {}
            for x in left:
                for w in x:
                    counts[w] = counts.get(w, 0) + 1
            out.append(max(sorted(counts), key=lambda w: (counts[w], len(w))))
            left = [x for x in left if out[-1] not in x]
    return out


def read_templates(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Whole texts of licenses, (name of the file, text), of a folder that Spark can read; files without words are passed over."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+?)(?:\\.txt)?$", 1).alias("name"), "value").collect()
    return sorted((r["name"], r["value"]) for r in rows if words_of(r["value"]))


def _signature(shingles, bands: int):
    """The least hash of a shingle set under each of ``bands`` seeded hash functions."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda i: F.array_min(F.transform(shingles, lambda s: F.xxhash64(i, s))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, clues=None) -> DataFrame:
    """One row per row of ``docs``: id and ``found`` (license, template, containment, first word of the window)."""
    templates, clues = templates or TEMPLATES, clues or CLUES
    if not clues_suffice(templates, clues):
        raise ValueError("a template can match without a clue word")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(F.lower(text), _SEPARATORS, -1), lambda w: w != "")
    df = docs.select(F.col(id_col), F.when(text.rlike("(?i)" + "|".join(clues)), words).otherwise(F.array().cast("array<string>")).alias("words"))
    by: dict[int, list[int]] = {}
    for k, (_, template) in enumerate(templates):
        by.setdefault(len(words_of(template)), []).append(k)
    parts = []
    for length, members in sorted(by.items()):
        bands = bands_for(length)
        rows = [(templates[k][0], k, shingles_of(words_of(templates[k][1]))) for k in members]
        known = spark.createDataFrame(rows, "license string, template int, shingles array<string>").withColumn("signature", _signature(F.col("shingles"), bands)).collect()
        # one literal an array, split once when the plan is made, as whole texts have thousands of shingles
        whole = lambda xs: F.split(F.lit("\n".join(map(str, xs))), "\n")
        table = F.array(*[F.struct(F.lit(r["license"]).alias("license"), F.lit(r["template"]).alias("template"), whole(r["shingles"]).alias("shingles"), whole(r["signature"]).cast("array<bigint>").alias("signature")) for r in known])
        df = df.withColumn(f"m{length}", _matches(length, bands, table, clues))
        parts.append(F.col(f"m{length}"))
    return df.select(id_col, F.concat(*parts).cast(FOUND).alias("found"))


def _matches(length: int, bands: int, table, clues):
    """The matches of the templates of one length in a text's ``words``."""
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words"), F.lit(length))).otherwise(F.array().cast("array<int>"))
    slices = F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice("words", s, F.lit(2 * length)).alias("own")))
    told = F.filter(slices, lambda w: F.arrays_overlap(w["own"], F.array(*map(F.lit, clues))))
    shingles = F.transform(
        told,
        lambda w: F.struct(
            w["at"].alias("at"),
            F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w["own"]) - SHINGLE + 1)), lambda i: F.array_join(F.slice(w["own"], i, F.lit(SHINGLE)), " ")).alias("own"),
        ),
    )
    signed = F.transform(shingles, lambda w: F.struct(w["at"].alias("at"), w["own"].alias("own"), _signature(w["own"], bands).alias("signature")))
    held = lambda t, own: F.array_intersect(t["shingles"], own)
    found = F.transform(
        signed,
        lambda w: F.filter(
            F.transform(
                F.filter(table, lambda t: F.arrays_overlap(t["signature"], w["signature"])),
                lambda t: F.struct(t["license"].alias("license"), t["template"].alias("template"), (F.size(held(t, w["own"])) / F.size(t["shingles"])).alias("containment"), w["at"].alias("word"), held(t, w["own"]).alias("held")),
            ),
            lambda m: m["containment"] >= MATCH,
        ),
    )
    # of templates that match the same shingles, those that the window holds most of
    better = lambda m, o: (o["containment"] > m["containment"]) & (F.size(F.array_except(m["held"], o["held"])) == 0)
    kept = F.transform(found, lambda ms: F.filter(ms, lambda m: ~F.exists(ms, lambda o: better(m, o))))
    return F.transform(F.flatten(kept), lambda m: F.struct(*[m[c].alias(c) for c in ("license", "template", "containment", "word")]))
