"""Licence scan with native expressions: MinHash bands over overlapping windows, then exact shingle containment.

A text becomes its sequence of five-word shingle hashes. Windows of eight shingles begin at every fourth place of a
document and at every place of a template, so a copied run of eleven shingles always holds a document window that is also
a template window, shingle for shingle, and collides in every band. Windows with an edit collide by their similarity s with
probability 1 - (1 - s^2)^4: 0.83 at s = 0.6, 0.96 at 0.75 (four bands of two minima). Templates of ten shingles or fewer are
shorter than that and are retrieved by windows of a single shingle, whose minimum is the shingle itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SHINGLE_WORDS, named

TILE = 4
BANDS, ROWS = 4, 2
SHORT = 10
CONTAINMENT = 0.75
MOST_TEMPLATES = 1_000
# Flipping different leading bits orders the hashes in a different way for each minimum.
FLIPS = [(i << 61) - (1 << 63) + 0x1D8E4E27C47D124 * i for i in range(BANDS * ROWS)]

# --- fixed values: public licence notices ---------------------------------------------------------------------------
LICENSES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)
# --- end of fixed values --------------------------------------------------------------------------------------------


def shingles(text: Column) -> Column:
    """Hashes of the word shingles of a text in order (A-Z lowered); fewer than five words: one shingle; none: empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(lowered, "[\\x20\\x09-\\x0D]+"), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE_WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE_WORDS)]))
        few = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
        return F.when(F.size(h) < SHINGLE_WORDS, few).otherwise(many)

    return bound(hashes, of)


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def band_keys(minima: Sequence[Column]) -> Column:
    """One key per band from the window's minima."""
    return F.array(*[F.xxhash64(F.lit(b), *minima[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])


def minima(values: Column) -> list[Column]:
    return [F.array_min(F.transform(values, lambda x, f=f: x.bitwiseXOR(F.lit(f)))) for f in FLIPS]


def grid_windows(sequence: Column) -> Column:
    """``(place, keys)`` of the windows of two neighbouring tiles of four shingles."""
    tiles = F.transform(F.sequence(F.lit(0), F.floor(F.size(sequence) / TILE).cast("int") - 1), lambda t: F.array(*minima(F.slice(sequence, t * TILE + 1, TILE))))

    def windows(tile: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(tile) - 2)
        pair = lambda t, k: F.least(tile[t][k], tile[t + 1][k])
        return F.transform(at, lambda t: F.struct((t * TILE).alias("place"), band_keys([pair(t, k) for k in range(BANDS * ROWS)]).alias("keys")))

    return F.when(F.size(sequence) >= 2 * TILE, bound(tiles, windows))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """``template, license, short, sequence``: the templates' shingles, made by the same expressions as a document's."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates at a time")
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, text string")
    cut = table.withColumn("sequence", shingles(F.col("text"))).where("size(sequence) > 0")
    return cut.select("template", "license", (F.size("sequence") <= SHORT).alias("short"), "sequence")


def template_keys(table: DataFrame) -> DataFrame:
    """``key, template, inside``: every retrieval key of every template and its place in the template."""
    short = table.where("short").select("template", F.posexplode("sequence").alias("inside", "key"))
    place = F.explode(F.sequence(F.lit(0), F.size("sequence") - 2 * TILE)).alias("inside")
    windows = table.where("not short").select("template", "sequence", place)
    windows = windows.select("template", "inside", F.explode(band_keys(minima(F.slice("sequence", F.col("inside") + 1, 2 * TILE)))).alias("key"))
    return short.select("key", "template", "inside").union(windows.select("key", "template", "inside"))


def find_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = LICENSES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license, containment, first_word``: one row per document id and licence found.

    A licence is found where at least three quarters of a template's distinct shingles stand in a stretch of the text that
    is twice as long as the template, around a retrieved window; the best template and stretch count (ties: the first).
    Null, empty and shorter texts hold none. Rows that repeat a doc_id (null too) share their result. Documents are not
    shuffled: keys are looked up in the row among those of the templates (a fixed list of at most 1,000), and only hits
    become rows.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    keys = template_keys(table).collect()  # bounded by the list of templates
    short_of = {r.template for r in table.where("short").select("template").collect()}
    short_keys = sorted({r.key for r in keys if r.template in short_of})
    long_keys = sorted({r.key for r in keys if r.template not in short_of})
    rows = named(docs, doc_id=doc_id, text=text)

    def hits(sequence: Column) -> Column:
        none = F.lit(None).cast("array<struct<place:int,key:bigint>>")
        one = F.filter(F.transform(sequence, lambda x, i: F.struct(i.alias("place"), x.alias("key"))), lambda h: h["key"].isin(short_keys)) if short_keys else none
        flat = F.flatten(F.transform(grid_windows(sequence), lambda w: F.transform(w["keys"], lambda k: F.struct(w["place"].alias("place"), k.alias("key")))))
        many = F.filter(flat, lambda h: h["key"].isin(long_keys)) if long_keys else none
        return F.concat(F.coalesce(one, F.array().cast("array<struct<place:int,key:bigint>>")), F.coalesce(many, F.array().cast("array<struct<place:int,key:bigint>>")))

    # the sequence is bound once per row: the hits are looked for inside one expression
    read = bound(shingles(F.col("text")), lambda s: bound(hits(s), lambda h: F.when(F.size(h) > 0, F.struct(s.alias("sequence"), h.alias("hits")))))
    found = rows.select("doc_id", F.explode(F.array_compact(F.array(read))).alias("read")).select("doc_id", "read.sequence", F.explode("read.hits").alias("hit"))
    lookup = spark.createDataFrame([(r.key, r.template, r.inside) for r in keys], "key bigint, template int, inside int")
    wanted = table.select("template", "license", F.array_distinct("sequence").alias("wanted"))
    near = found.withColumn("key", F.col("hit.key")).join(F.broadcast(lookup.join(wanted, "template")), "key")
    start = F.greatest(F.col("hit.place") - F.col("inside") - F.floor(F.size("wanted") / 2).cast("int"), F.lit(0))
    stretch = F.slice("sequence", F.col("start") + 1, 2 * F.size("wanted"))
    scored = near.withColumn("start", start).withColumn("containment", F.size(F.array_intersect("wanted", stretch)) / F.size("wanted"))
    place = F.greatest(F.col("hit.place") - F.col("inside"), F.lit(0))
    best = F.max(F.struct(F.col("containment"), (-place).alias("at")))
    return (
        scored.where(F.col("containment") >= CONTAINMENT)
        .groupBy("doc_id", "license")
        .agg(best.alias("best"))
        .select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.at")).cast("int").alias("first_word"))
    )
