"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies. Native.

Words are runs of letters and digits, lower-cased; a shingle is ``SHINGLE`` words, hashed to 64 bits. A template of m
distinct shingles is looked for in windows of 2 m shingles that start at every m-th shingle, so any run of m shingles
lies whole in one of them. A set's signature has ``BANDS`` bands of ``ROWS`` values, each the least hash of the set under a
permutation of its own (hashes xor a constant); a window retrieves a template if they agree in all rows of a band. A
window that holds a share c of the template has a similarity of at least c m / (2 m + (1 - c) m), so it is missed with
probability (1 - s^ROWS)^BANDS at most: under 2e-8 for a whole copy (s = 1/2), under 2e-4 at the containment of 0.8
(s = 0.36). ``miss`` computes it. A template of one shingle has windows of one shingle, which agree in every row.

A window can only share a band if it holds the template's own value of the band's first row. So every text's shingles
are first met with the table of these values (one row for each number of words of a shingle, joined by broadcast: at most
``TEMPLATES`` templates at a time, more go in turn), and only where they meet are the window's minima worked out: all rows of the
band over the whole window, which gives just what every window's full signature would.

A retrieved template is verified by the exact share of its shingles (as strings) that the whole text contains; matches
reach ``CONTAINMENT``. No Python runs on the executors.

Defined cases: null, empty and very short texts match nothing; texts of any length are scanned whole; a template of
fewer words than a shingle is one shingle of all its words, met by runs of as many words; one without a word is an
error; repeated rows match alike; other columns, whatever their names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.common import picked

SHINGLE, CONTAINMENT = 5, 0.8
BANDS, ROWS = 64, 2
#: Templates whose signatures (a few dozen KB for each hundred) are sent to all executors together.
TEMPLATES = 4096
BREAK = r"[^\p{L}\p{N}]+"

#: Short notices as they stand in files and pages.
LICENSES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-line": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_shingles(text: str, k: int = SHINGLE) -> list[str]:
    """Distinct shingles of a template (ASCII)."""
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))})


def _bind(value: Column, body) -> Column:
    """``body`` of ``value`` computed once a row (a projection might inline it into every use)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def miss(size: int, share: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Bound of the probability that a window with this share of a template of ``size`` shingles doesn't retrieve it."""
    similarity = 1.0 if size == 1 else share * size / (2 * size + (1 - share) * size)
    return (1 - similarity**rows) ** bands


def permutations(bands: int = BANDS, rows: int = ROWS) -> list[list[int]]:
    """The constants of each band's rows, as longs."""
    digest = lambda b, r: hashlib.blake2b(f"{b} {r}".encode(), digest_size=8).digest()
    return [[int.from_bytes(digest(b, r), "little", signed=True) for r in range(rows)] for b in range(bands)]


def _hashes(words: Column, k: int) -> Column:
    """The hash of each shingle of k words, in order: words are chained, not joined."""
    own = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) >= k, own).otherwise(F.array().cast("array<bigint>"))


def _least(hashes: Column, constants: Column) -> Column:
    """The hash of ``hashes`` that each row's permutation makes the least."""
    return F.transform(constants, lambda c: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(c))).bitwiseXOR(c))


def signatures(spark: SparkSession, library: dict[str, list[str]], bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """name, m (shingles), k (words of a shingle), constants and values (rows of the band) of each template and band."""
    words = [(name, len(own), len(own[0].split(" ")), [s.split(" ") for s in own]) for name, own in library.items()]
    table = spark.createDataFrame(words, "name string, m int, k int, own array<array<string>>")
    of_width = lambda k: F.transform("own", lambda s: F.xxhash64(*(F.get(s, F.lit(j)) for j in range(k))))
    hashes = F.coalesce(*(F.when(F.col("k") == k, of_width(k)) for k in sorted({w[2] for w in words})))
    constants = F.explode(F.array(*(F.array(*map(F.lit, own)).cast("array<bigint>") for own in permutations(bands, rows)))).alias("constants")
    spread = table.select("name", "m", "k", hashes.alias("hashes"), constants)
    return spread.select("name", "m", "k", "constants", _least(F.col("hashes"), F.col("constants")).alias("values"))


def scan(df: DataFrame, templates: dict[str, str] | None = None, k: int = SHINGLE, containment: float = CONTAINMENT, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, license, n_shingles (of the template), n_found, containment: one row per document and template found."""
    spark = df.sparkSession
    docs = picked(df, doc_id=(doc_id, T.LongType()), text=(text, T.StringType()))
    library = {name: template_shingles(t, k) for name, t in sorted((LICENSES if templates is None else templates).items())}
    if not all(own[0] for own in library.values()):
        raise ValueError("a template without a word")
    names = list(library)
    out = None
    for at in range(0, len(names), TEMPLATES):
        own = _scan(spark, docs, {n: library[n] for n in names[at : at + TEMPLATES]}, containment, bands, rows)
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], "doc_id long, license string, n_shingles long, n_found long, containment double") if out is None else out


def _scan(spark: SparkSession, docs: DataFrame, library: dict[str, list[str]], containment: float, bands: int, rows: int) -> DataFrame:
    first = lambda of: F.get(of["values"], F.lit(0))
    known = signatures(spark, library, bands, rows).groupBy("k").agg(F.collect_list(F.struct("name", "m", "constants", "values")).alias("of"))
    known = known.select("k", "of", F.array_distinct(F.transform("of", first)).alias("firsts"))
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), BREAK), lambda w: w != "")
    widths = sorted({len(own[0].split(" ")) for own in library.values()})
    layers = F.array(*(F.struct(F.lit(n).alias("k"), _hashes(F.col("words"), n).alias("hashes")) for n in widths))
    layered = docs.select("doc_id", "text", words.alias("words")).select("doc_id", "text", F.explode(layers).alias("x")).select("doc_id", "text", "x.k", "x.hashes")
    met = layered.join(F.broadcast(known), "k").where(F.arrays_overlap("firsts", "hashes"))

    def retrieves(of: Column, hits: Column) -> Column:
        """Whether some window agrees with a template in all rows of a band; windows around the first row's own value can."""
        m = of["m"]
        at = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.get(F.col("hashes"), i) == first(of))
        agrees = lambda b: _least(F.slice(F.col("hashes"), b * m + 1, 2 * m), of["constants"]) == of["values"]
        block = lambda i: F.floor(i / m).cast("int")
        blocks = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(block(i), F.greatest(F.lit(0), block(i) - 1)))))
        return F.array_contains(hits, first(of)) & F.when(m == 1, True).otherwise(F.exists(blocks, agrees))

    found = _bind(F.array_intersect("firsts", "hashes"), lambda hits: F.array_distinct(F.transform(F.filter("of", lambda of: retrieves(of, hits)), lambda of: of["name"])))
    pairs = met.select("doc_id", "text", F.explode(found).alias("license"))
    table = spark.createDataFrame([(n, len(own[0].split(" ")), own) for n, own in library.items()], "license string, k int, shingles array<string>")
    pairs = pairs.join(F.broadcast(table), "license")
    spelt = F.filter(F.split(F.lower("text"), BREAK), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - F.col("k"))), lambda i: F.array_join(F.slice(w, i + 1, F.col("k")), " "))
    count = _bind(spelt, lambda w: F.size(F.array_intersect("shingles", runs(w)))).cast("long").alias("n_found")
    out = pairs.select("doc_id", "license", F.size("shingles").cast("long").alias("n_shingles"), count)
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= containment)


def oracle(templates: dict[str, str] | None = None, k: int = SHINGLE, containment: float = CONTAINMENT) -> str:
    """The same matches by brute force, in DuckDB SQL: every shingle of every document against every template."""
    library = {name: template_shingles(t, k) for name, t in sorted((LICENSES if templates is None else templates).items())}
    values = ", ".join(f"('{name}', {len(own)}, '{s}')" for name, own in library.items() for s in own)
    return f"""
WITH template(license, n_shingles, shingle) AS (VALUES {values}),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
own AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS shingle FROM words)
SELECT doc_id, license, CAST(any_value(n_shingles) AS BIGINT) AS n_shingles, count(*) AS n_found, count(*) / CAST(any_value(n_shingles) AS DOUBLE) AS containment
FROM own JOIN template USING (shingle) GROUP BY doc_id, license HAVING count(*) / CAST(any_value(n_shingles) AS DOUBLE) >= {containment}"""
