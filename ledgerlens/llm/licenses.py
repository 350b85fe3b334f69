"""License scans: MinHash bands of overlapping text windows retrieve templates; exact shingle
containment confirms them.

Only built-in functions, and everything about a text stays in its row. A template is indexed by the
bands of all its windows. Templates of fewer than SHORT shingles have windows of one shingle, whose
MinHash is its hash; others have windows of WIDE shingles. A text's wide windows begin at every
STRIDE-th word, so any run of WIDE + STRIDE - 1 intact shingles of a template holds a whole text
window, equal to one of the template's: all bands collide, with certainty. A template that keeps
80 % of its shingles after edits in a row has such a run, at the least sizes too.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.quality import once

SHINGLE_WORDS = 5
CONTAINMENT = 80  # per cent
SHORT, WIDE, STRIDE = 8, 4, 2
# One band per value; 1 orders shingles by their hash, others by its halves swapped and mixed.
BAND_MIXERS = [1, 7046029254386353131]
# The templates are written into the plan.
MAX_TEMPLATE_WORDS = 20_000

# Notices and clauses of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons"
        " to whom the Software is furnished to do so, subject to the following conditions: The above"
        " copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the Software."),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met: Redistributions of source code"
        " must retain the above copyright notice, this list of conditions and the following"
        " disclaimer. Redistributions in binary form must reproduce the above copyright notice, this"
        " list of conditions and the following disclaimer in the documentation and/or other"
        " materials provided with the distribution."),
    # The GNU notices leave out the version, by which alone their usual wordings differ too little.
    "GPL-notice": (
        "redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation"),
    "LGPL-notice": (
        "redistribute it and/or modify it under the terms of the GNU Lesser General Public License"
        " as published by the Free Software Foundation"),
    "LGPL-2.0-notice": (
        "redistribute it and/or modify it under the terms of the GNU Library General Public License"
        " as published by the Free Software Foundation"),
    "AGPL-notice": (
        "redistribute it and/or modify it under the terms of the GNU Affero General Public License"
        " as published by the Free Software Foundation"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a"
        " copy of the MPL was not distributed with this file, You can obtain one at"),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to"
        " copy, modify, publish, use, compile, sell, or distribute this software, either in source"
        " code form or as a compiled binary, for any purpose, commercial or non-commercial, and by"
        " any means."),
    "CC0-1.0": "waived all copyright and related or neighboring rights to",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    **{f"CC-{code}-4.0-notice": (
        f"licensed under a Creative Commons {name} 4.0 International License")
       for code, name in {
           "BY": "Attribution", "BY-SA": "Attribution-ShareAlike",
           "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
           "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
           "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items()},
}


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: str) -> Column:
    each = ", ".join(f"{words}[i + {k}]" for k in range(SHINGLE_WORDS))
    return F.expr(
        f"transform(if(size({words}) >= {SHINGLE_WORDS}, sequence(0, size({words}) -"
        f" {SHINGLE_WORDS}), cast(array() AS array<int>)), i -> xxhash64({each}))")


def _wide(hashes: str, stride: int, factor: int) -> Column:
    """MinHash, under one permutation, of every stride-th window of WIDE shingles."""
    each = ", ".join(f"{hashes}[i + {k}]" for k in range(WIDE))
    least = f"least({each})" if factor == 1 else (
        f"array_min(transform(array({each}), h -> shiftleft(h, 32) ^ shiftrightunsigned(h, 17)"
        f" ^ {factor}L))")
    return F.expr(
        f"transform(if(size({hashes}) >= {WIDE}, sequence(0, size({hashes}) - {WIDE}, {stride}),"
        f" cast(array() AS array<int>)), i -> {least})")


def template_index(spark: SparkSession, templates: Mapping[str, str]) -> list[dict]:
    """name, shingle hashes, and band keys (of single shingles or of wide windows) per template."""
    total = sum(len(re.findall("[a-z0-9]+", t.lower())) for t in templates.values())
    if total > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of {total} words are more than {MAX_TEMPLATE_WORDS}")
    if not templates:
        return []
    rows = " UNION ALL ".join(f"SELECT {i} AS i" for i in range(len(templates)))
    names = list(templates)
    text = F.element_at(F.array(*[F.lit(templates[n]) for n in names]), F.col("i") + 1)
    df = once(spark.sql(rows).withColumn("w", words_of(text)), h=_shingles("w"))
    bands = [_wide("h", 1, f).alias(f"b{k}") for k, f in enumerate(BAND_MIXERS)]
    out = []
    for r in df.select("i", "h", *bands).orderBy("i").collect():
        short = len(r["h"]) < SHORT
        out.append({
            "name": names[r["i"]], "shingles": sorted(set(r["h"])), "span": len(r["h"]),
            "short": sorted(set(r["h"])) if short else [],
            "wide": [[] if short else sorted(set(r[f"b{k}"])) for k in range(len(BAND_MIXERS))]})
    return [t for t in out if t["shingles"]]


def few_words(templates: Mapping[str, str]) -> dict[str, str]:
    """The words of each template too short for a shingle, between single spaces."""
    words = {n: re.findall("[a-z0-9]+", t.lower()) for n, t in templates.items()}
    return {n: f" {' '.join(w)} " for n, w in words.items() if 0 < len(w) < SHINGLE_WORDS}


def _longs(values: list[int]) -> str:
    return "cast(array(" + ",".join(f"{v}L" if v > -2 ** 63 else f"({v + 1}L - 1L)"
                                    for v in values) + ") AS array<bigint>)"


def _hits(hashes: Column, keys: set[int], stride: int) -> Column:
    """Positions (in words) of the windows whose key is indexed."""
    if not keys:
        return F.expr("cast(array() AS array<int>)")
    known = F.transform(hashes, lambda h, i: F.when(h.isin(sorted(keys)), i * stride))
    return F.filter(known, lambda i: i.isNotNull())


def _confirmed(template: dict) -> Column:
    """The template's best containment around its hits, in per cent; needs __h and hit columns."""
    span, size = template["span"], len(template["shingles"])
    spots = "__short" if template["short"] else "__wide"
    return F.expr(
        f"array_max(transform({spots}, p -> 100 * size(array_intersect(slice(__h, greatest(p -"
        f" {span}, 0) + 1, {2 * span + WIDE}), {_longs(template['shingles'])})) div {size}))")


def scan(
    docs: DataFrame,
    into: str = "licenses",
    text_column: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add a struct: n_words, and found, an array of (name, containment) sorted by name.

    Words are lower-cased runs of ASCII letters and digits. A template is found if some stretch of
    the text, at most twice as long, holds at least 80 % of its distinct five-word shingles (the
    per cent are rounded down). A template of fewer than five words is found, with 100, where all its
    words follow each other; one without words is never found.

    Null and empty texts have no words and no licenses; texts are scanned whole; repeated rows get
    equal results; an empty table stays empty. An input column named as `into` is replaced, others
    pass unchanged.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]
    index = template_index(docs.sparkSession, templates)
    df = docs.select(
        *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(columns)],
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("__t"))
    df = once(df, __w=words_of(F.col("__t")))
    df = once(df, __h=_shingles("__w"))
    short = {k for t in index for k in t["short"]}
    wide = [{k for t in index for k in t["wide"][b]} for b in range(len(BAND_MIXERS))]
    df = once(
        df, __short=_hits(F.col("__h"), short, 1),
        __wide=F.array_distinct(F.concat(*[
            _hits(_wide("__h", STRIDE, f), wide[b], STRIDE) for b, f in enumerate(BAND_MIXERS)])))
    few = few_words(templates)
    if few:
        spaced = F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" "))
        df = once(df, __spaced=spaced)
    held_in = {t["name"]: _confirmed(t).cast("int") for t in index}
    held_in |= {n: F.when(F.contains("__spaced", F.lit(w)), 100) for n, w in few.items()}
    found = [F.struct(F.lit(n).alias("name"), c.alias("containment"))
             for n, c in sorted(held_in.items(), key=lambda x: x[0])]
    kind = "array<struct<name:string,containment:int>>"
    none = F.expr("array()").cast(kind)
    held = F.filter(F.array(*found), lambda x: F.coalesce(
        x["containment"] >= CONTAINMENT, F.lit(False))).cast(kind) if found else none
    hit = (F.size("__short") > 0) | (F.size("__wide") > 0)
    for words in few.values():
        hit = hit | F.contains("__spaced", F.lit(words))
    result = F.struct(
        F.size("__w").cast("long").alias("n_words"), F.when(hit, held).otherwise(none).alias("found"))
    return df.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(columns)], result.alias(into))
