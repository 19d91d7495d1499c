"""License scans, in SQL functions only.

A template matches where a text window holds at least ``CONTAINED`` of its distinct shingles. Windows
overlap and have the size of the template (rounded up to a power of two words), so each occurrence
lies whole inside one. Min-hash bands of one row retrieve the templates of a window; their number
follows from the least similarity that a matching window of the class can have, so that the chance
of missing one is below ``MISS``. Retrieved pairs are then verified by exact containment.

A window without any shingle of any template can agree with no template's signature, so shingles are
looked up first and only windows around them are hashed: the scan itself is one pass of native
functions, and what is shuffled follows the license text found, not the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-6
LEAST = 8  #: words of the smallest class

#: Default templates: grant lines and permission notices as the licenses word them (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            'associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
)


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits; other characters set words apart. NULL: none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(words: Column, k: int = SHINGLE) -> Column:
    """Hashes of the runs of ``k`` words; fewer words have none."""
    def over(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")
    return F.element_at(F.transform(F.array(hashed), lambda h: F.when(F.size(h) >= k, over(h)).otherwise(none)), 1)


def _class(n_words: int, least: int = LEAST) -> int:
    return max(least, 1 << (n_words - 1).bit_length())


def bands_for(size: int, contained: float = CONTAINED, miss: float = MISS, k: int = SHINGLE) -> int:
    """Bands of one min-hash that leave less than ``miss`` for a match in a class of ``size`` words:
    its shortest template against a window of 2 * size words that holds ``contained`` of it."""
    short = (size // 2 + 1 if size > LEAST else k) - k + 1
    window = 2 * size - k + 1
    shared = math.ceil(contained * short)
    similar = shared / (window + short - shared)
    return math.ceil(math.log(miss) / math.log1p(-similar))


def prepared(spark, templates) -> DataFrame:
    """``templates`` (license, text) pairs -> (template, license, size, own): its class and distinct
    shingles. Templates below ``SHINGLE`` words can't be told and are left out."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, license string, text string")
    w = rows.withColumn("w", words(F.col("text")))
    size = F.greatest(F.lit(LEAST), F.pow(F.lit(2.0), F.ceil(F.log2(F.size("w").cast("double")))).cast("int"))
    return (w.filter(F.size("w") >= SHINGLE)
            .select("template", "license", size.alias("size"), F.array_distinct(shingles(F.col("w"))).alias("own")))


def _signature(own: Column, bands: Column) -> Column:
    """Min-hash of each band over an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(1), bands), lambda b: F.array_min(F.transform(own, lambda s: F.xxhash64(s, b))))


def scanned(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """Per document and license that matches: doc_id, license, containment (largest share of a
    template's shingles in a window), n_windows (windows that match some template of the license).

    NULL, empty and short texts match nothing; rows of one doc_id count together (NULL ids too); an
    empty table or no template gives an empty result.
    """
    spark = docs.sparkSession
    known = prepared(spark, templates)  # as many rows as the caller's templates
    rows = docs.select("doc_id", shingles(words(F.col("text"))).alias("sh"))
    # the shingles of all templates, as many as the caller's templates have
    wanted = F.array(*[F.lit(r["s"]) for r in known.select(F.explode("own").alias("s")).distinct().sort("s").collect()]).cast("array<bigint>")
    hit = (rows.filter(F.arrays_overlap(F.col("sh"), wanted))
           .withColumn("hits", F.filter(F.sequence(F.lit(0), F.size("sh") - 1), lambda i: F.array_contains(wanted, F.get("sh", i)))))
    sizes = sorted({_class(len(_plain_words(t))) for _, t in templates if len(_plain_words(t)) >= SHINGLE})
    if not sizes:
        return rows.limit(0).select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_windows"))
    # windows of 2 * size words begin at every multiple of size; a shingle at i lies in two of them
    def places_of(n):
        def around(i):
            return F.filter(F.array(F.floor(i / n), F.floor(i / n) - 1), lambda w: (w >= 0) & (i - w * n <= 2 * n - SHINGLE))

        begins = F.array_distinct(F.flatten(F.transform("hits", around)))
        return F.transform(begins, lambda w: F.struct(F.lit(n).alias("size"), w.alias("w")))

    places = F.flatten(F.array(*map(places_of, sizes)))
    window = F.slice("sh", (F.col("p.w") * F.col("p.size") + 1).cast("int"), (2 * F.col("p.size") - SHINGLE + 1).cast("int"))
    windows = (hit.select("doc_id", "sh", F.explode(places).alias("p"))
               .select("doc_id", "p.size", "p.w", F.array_distinct(window).alias("held")))
    n_bands = F.element_at(F.create_map(*[x for n in sizes for x in (F.lit(n), F.lit(bands_for(n, contained)))]), F.col("size"))
    band = lambda d, own: d.select("*", F.posexplode(_signature(F.col(own), n_bands)).alias("band", "value"))
    found = (band(windows, "held").join(F.broadcast(band(known, "own")), ["size", "band", "value"])
             .select("doc_id", "size", "w", "held", "template", "license", "own").distinct())
    share = F.size(F.array_intersect("own", "held")) / F.size("own")
    return (found.withColumn("share", share).filter(F.col("share") >= contained)
            .groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.count_distinct("size", "w").alias("n_windows")))


def _plain_words(text: str) -> list[str]:
    import regex
    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def oracle(templates=TEMPLATES, contained: float = CONTAINED) -> str:
    """DuckDB SQL of ``scanned`` over ``documents``: every template against every window."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(a)}, {quoted(b)}, {_class(len(_plain_words(b)))})" for i, (a, b) in enumerate(templates)
                       if len(_plain_words(b)) >= SHINGLE)
    words_of = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"
    run = f"array_to_string(list_slice(w, i + 1, i + {SHINGLE}), ' ')"
    return f"""
WITH t AS (SELECT template, license, size, {words_of.format('text')} AS w FROM (VALUES {values}) v(template, license, text, size)),
ts AS (SELECT DISTINCT template, license, size, {run} AS s FROM (SELECT *, unnest(range(0, len(w) - {SHINGLE - 1})) AS i FROM t)),
tn AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
d AS (SELECT doc_id, {words_of.format('text')} AS w FROM documents),
ds AS (SELECT doc_id, i, {run} AS s FROM (SELECT *, unnest(range(0, greatest(len(w) - {SHINGLE - 1}, 0))) AS i FROM d)),
m AS (SELECT doc_id, i, template, license, size, s FROM ds JOIN ts USING (s)),
p AS (SELECT *, i // size - k AS win FROM m, (VALUES (0), (1)) o(k)),
c AS (SELECT doc_id, template, license, size, win, count(DISTINCT s) AS n FROM p
      WHERE win >= 0 AND i - win * size <= 2 * size - {SHINGLE} GROUP BY ALL),
r AS (SELECT c.doc_id, c.license, c.size, c.win, c.n / tn.n AS share FROM c JOIN tn USING (template) WHERE c.n / tn.n >= {contained})
SELECT doc_id, license, max(share) AS containment, count(DISTINCT (size, win)) AS n_windows FROM r GROUP BY doc_id, license"""
