"""License notices in documents, found with DataFrame functions only.

Text and templates are taken as 3-word shingles (ASCII letters and digits, lower case). A document is covered by
overlapping windows of six shingles, four apart, and every template by segments of three, so that a segment that occurs
whole lies whole in some window and makes up at least half of it. Each of 16 MinHash permutations is a band of its own:
a window proposes a segment when their minima agree under any of them, which a whole segment misses with a chance of
2^-16, and one that lost a shingle with half a percent; a template has several. Every proposal is then checked exactly:
the share of the template's shingles that occur in the stretch of text where it would lie must reach ``CONTAINED``.

The templates are a fixed short list, so their band keys are literals in the plan: the scan is one projection, and only
matches are shuffled. No list grows with anything but its own document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entityframe.llm.text import let, whole

WINDOW, STRIDE, SEGMENT = 6, 4, 3
SHINGLE_WORDS = 3
CONTAINED = 0.8
SLACK = 2 * WINDOW
_MASKS = tuple((0x9E3779B97F4A7C15 * (2 * k + 1) ^ (k << 60)) % (1 << 64) - (1 << 63) for k in range(16))

# Wordings of public licences, as (licence, kind, text).
TEMPLATES = (
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "permissive", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "permissive", "Released under the MIT License"),
    ("MIT", "permissive", "Licensed under the MIT License"),
    ("MIT", "permissive", "This project is licensed under the terms of the MIT license"),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL", "copyleft", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "copyleft", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "permissive", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)


@dataclass(frozen=True)
class Compiled:
    """Shingles of every template, and per permutation the minima of all segments with where they come from."""

    hashes: list[list[int]]
    keys: list[dict[int, list[tuple[int, int]]]]


def shingles(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(whole(text)), r"[^a-z0-9]+"), "")

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= SHINGLE_WORDS, F.sequence(F.lit(0), F.size(w) - SHINGLE_WORDS)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE_WORDS)]))

    return let(words, of)


def compile_templates(spark: SparkSession, templates: tuple[tuple[str, str, str], ...] = TEMPLATES) -> Compiled:
    rows = spark.createDataFrame([(i, t[2]) for i, t in enumerate(templates)], "i int, t string").select("i", shingles(F.col("t")).alias("h"))
    hashes = [r["h"] for r in sorted(rows.collect(), key=lambda r: r["i"])]
    if short := [templates[i][2] for i, h in enumerate(hashes) if len(h) < SEGMENT]:
        raise ValueError(f"templates of under five words: {short}")
    keys: list[dict[int, list[tuple[int, int]]]] = [{} for _ in _MASKS]
    for i, h in enumerate(hashes):
        for at in range(len(h) - SEGMENT + 1):
            for k, mask in enumerate(_MASKS):
                keys[k].setdefault(min(x ^ mask for x in h[at : at + SEGMENT]), []).append((i, at))
    return Compiled(hashes, keys)


def _minimum(hashes: Column, window: Column, mask: int) -> Column:
    return F.least(*[F.get(hashes, window * STRIDE + j).bitwiseXOR(F.lit(mask)) for j in range(WINDOW)])


def scan(docs: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and template found: ``doc_id, template, license, kind, containment, at_word, places``.

    ``containment`` is the best share of the template's distinct shingles found in one place, ``at_word`` the first place
    (a word number, up to a window early), ``places`` the number of proposals confirmed. Documents without a match, null
    and empty texts have no row. Rows without an id, or with one id, are told apart by their text; equal rows count as one.
    """
    own = compile_templates(docs.sparkSession, templates)
    known = sorted({x for h in own.hashes for x in h})

    def proposes(h: Column, j: Column) -> Column:
        return reduce(lambda a, b: a | b, [_minimum(h, j, mask).isin(list(own.keys[k])) for k, mask in enumerate(_MASKS)])

    def with_hits(h: Column) -> Column:
        # A minimum that is a template's is the hash of a template's shingle: windows without one need no minima.
        places = F.filter(F.transform(h, lambda x, i: F.when(x.isin(known), i)), lambda i: i.isNotNull())
        first = lambda p: F.greatest(F.ceil((p - (WINDOW - 1)) / STRIDE).cast("int"), F.lit(0))
        windows = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(first(p), F.floor(p / STRIDE).cast("int")))))
        return F.struct(h.alias("h"), F.filter(windows, lambda j: proposes(h, j)).alias("hits"))

    row = F.xxhash64(whole(F.col(text))).alias("__row")
    base = docs.select(F.col(doc_id).alias("doc_id"), row, let(shingles(F.col(text)), with_hits).alias("__s"))
    # Outer, so that no filter on the list is derived and computed a second time below the projection.
    hits = base.select("doc_id", "__row", F.col("__s.h").alias("__h"), F.explode_outer("__s.hits").alias("__j")).filter("__j is not null")
    h = F.col("__h")
    minima = F.array(*[F.struct(F.lit(k).alias("k"), _minimum(h, F.col("__j"), mask).alias("m")) for k, mask in enumerate(_MASKS)])
    banded = hits.select("doc_id", "__row", "__h", "__j", F.explode(minima).alias("__b"))
    # The templates' own keys: a fixed number of rows.
    proposals = docs.sparkSession.createDataFrame(
        [(k, m, i, at, own.hashes[i]) for k, found in enumerate(own.keys) for m, places in found.items() for i, at in places],
        "k int, m long, template int, segment int, own array<long>",
    )
    proposed = banded.join(F.broadcast(proposals), (F.col("__b.k") == F.col("k")) & (F.col("__b.m") == F.col("m")))
    start = F.greatest(F.col("__j") * STRIDE - F.col("segment") - WINDOW, F.lit(0))
    proposed = proposed.select("doc_id", "__row", "__h", "template", "own", start.alias("start"))
    stretch = F.slice("__h", F.col("start") + 1, F.size("own") + SLACK)
    share = F.size(F.array_intersect(stretch, "own")).cast("double") / F.size(F.array_distinct("own"))
    sure = proposed.select("doc_id", "__row", "template", "start", share.alias("share")).filter(F.col("share") >= CONTAINED)
    found = sure.groupBy("doc_id", "__row", "template").agg(
        F.max("share").alias("containment"), F.min("start").cast("long").alias("at_word"), F.count_distinct("start").alias("places")
    )
    names = F.create_map(*[F.lit(x) for i, t in enumerate(templates) for x in (i, f"{t[0]}\n{t[1]}")])
    named = found.withColumn("__name", F.split(names[F.col("template")], "\n"))
    return named.select("doc_id", "template", named["__name"][0].alias("license"), named["__name"][1].alias("kind"), "containment", "at_word", "places")
