"""License scan with native expressions: MinHash bands over overlapping windows, then exact containment.

Texts and templates are lower-cased sequences of letter-and-digit words, compared by
their three-word shingles.  Every text is covered by windows of four shingles, one
every two, so any three shingles in a row lie in one window; every template is
covered by pieces of three.  A window that holds a piece has a Jaccard similarity of
at least 3/4 with it, and each of the BANDS one-row bands collides with that
probability: a piece is missed with 4^-8, and a template only if all of its pieces
are.  Templates retrieved for a document are verified exactly: the share of their
shingles that the document holds must reach `least`.

The window rows stay inside code generation: four 64-bit values, eight minima of
exclusive-ors, eight set probes.  The template keys are a fixed list, so they are
literals of the plan, and the table that is broadcast is as long as that list.  Only documents with a hit are ever grouped.

Nulls and edges: null, empty and shorter texts have no shingles and no rows in the
result; a document is named once for each template, however often it holds it; rows
that share an id and a text are one document.  Texts of any length are covered by
windows from end to end; an empty table gives an empty result; columns other than the
named ones are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafonda.llm.common import read, require

WORDS, PIECE, SPAN, STEP, BANDS, LEAST = 3, 3, 4, 2, 8, 0.8
SPLIT = r"[^\p{L}\p{N}]+"

#: Notices of public licenses, by name (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under "
    "the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, "
    "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "AGPL-3.0": "licensed under the GNU Affero General Public License version 3",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


#: One exclusive-or permutation of hashes for each band.
MASKS = [_signed((k + 1) * 0x9E3779B97F4A7C15 ^ (k << 59)) for k in range(BANDS)]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def _hashes(words: Column) -> Column:
    """64-bit hashes of the shingles, in order, with repeats; `words` must be a column, not an expression (it is read for each shingle)."""
    at = F.sequence(F.lit(0), F.size(words) - WORDS)
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WORDS)]))
    return F.when(F.size(words) >= WORDS, hashed).otherwise(F.array().cast("array<bigint>"))


def _band(window: Column, size: int, mask: int) -> Column:
    return F.least(*[F.get(window, F.lit(i)).bitwiseXOR(F.lit(mask)) for i in range(size)])


def template_table(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[int], list[list[int]]]]:
    """(name, distinct shingle hashes, band keys of each piece); as long as the list of templates."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, notice string")
    out = []
    for name, hashes in rows.select("name", _words(F.col("notice")).alias("words")).select("name", _hashes(F.col("words"))).collect():
        starts = [*range(0, max(len(hashes) - PIECE, 0), PIECE), max(len(hashes) - PIECE, 0)]
        pieces = [hashes[a : a + PIECE] for a in starts if hashes]
        out.append((name, sorted(set(hashes)), [[min(_signed(h ^ m) for h in p) for m in MASKS] for p in pieces]))
    return out


def license_scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST
) -> DataFrame:
    """(id, license, n_shared, n_template, containment) of every template that a document holds."""
    table = template_table(docs.sparkSession, templates)
    known = F.array(*[F.lit(h) for h in sorted({h for _, hashes, _ in table for h in hashes})])
    rows = require(docs, id_col, text_col).toDF("id", "text")
    words = rows.select("id", _words(F.col("text")).alias("words"))
    hashed = words.select("id", _hashes(F.col("words")).alias("h"))
    count = F.greatest(F.ceil((F.size("h") - SPAN) / STEP).cast("int") + 1, F.lit(1))
    starts = F.sequence(F.lit(0), count - 1)
    windows = hashed.select("id", F.array_intersect("h", known).alias("present"), F.transform(starts, lambda j: F.slice("h", j * STEP + 1, SPAN)).alias("all"))
    # the outer form: the plain one lets the optimizer copy the array's expression into a filter on the scan
    windows = windows.select("id", "present", F.explode_outer("all").alias("w"))
    bands = windows.select("id", "present", *[_band(F.col("w"), SPAN, m).alias(f"b{k}") for k, m in enumerate(MASKS)])
    # few and small expressions: a generated method of over 8000 bytes would stay uncompiled
    keys = sorted({key for _, _, pieces in table for p in pieces for key in p})
    hit = F.lit(False)
    for k in range(BANDS):
        hit = hit | F.col(f"b{k}").isin(keys)
    found = bands.where(hit).select("id", "present", F.explode(F.array(*[f"b{k}" for k in range(BANDS)])).alias("key"))
    spread = [(key, name, hashes) for name, hashes, pieces in table for key in sorted({key for p in pieces for key in p})]
    lookup = F.broadcast(docs.sparkSession.createDataFrame(spread, "key bigint, license string, hashes array<bigint>"))  # as long as the template list
    pairs = found.join(lookup, "key").select("id", "license", "present", "hashes").distinct()
    shared = F.size(F.array_intersect("present", "hashes")).cast("bigint")
    checked = pairs.select("id", "license", shared.alias("n_shared"), F.size("hashes").cast("bigint").alias("n_template"))
    checked = checked.withColumn("containment", F.col("n_shared") / F.col("n_template"))
    return checked.where(F.col("containment") >= least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the license notices that each document holds."""
    return license_scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
    words = f"list_filter(regexp_split_to_array(lower(coalesce(x, '')), '{SPLIT}'), lambda s: s <> '')"
    cut = "unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))"
    return f"""
WITH t(name, x) AS (VALUES {values}),
tw AS (SELECT name, {words} AS ws FROM t),
ts AS (SELECT DISTINCT name, {cut} AS s FROM tw),
tn AS (SELECT name, count(*) AS n_template FROM ts GROUP BY name),
dw AS (SELECT doc_id, {words} AS ws FROM (SELECT doc_id, text AS x FROM documents)),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, {cut} AS s FROM dw) WHERE s IN (SELECT s FROM ts)),
c AS (SELECT doc_id, name, count(*) AS n_shared FROM ds JOIN ts USING (s) GROUP BY doc_id, name)
SELECT doc_id, name AS license, n_shared, n_template, n_shared / n_template AS containment
FROM c JOIN tn USING (name) WHERE n_shared / n_template >= {LEAST}"""


ORACLE_SQL = _sql()
