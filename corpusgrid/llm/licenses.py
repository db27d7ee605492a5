"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and documents are words: runs of letters and digits, lower-cased for ASCII. A template's fingerprints are
the smallest hashes of its three-word windows within every `WINNOW` neighbours; an inverted index leads from a fingerprint to the
templates and places that have it. A document looks up all its three-word windows, so that a run of four words in common cannot be
missed. Hits of a template whose diagonals lie within a band are one candidate; its words and the document's around it are aligned in a band
about the diagonal, for as many equal words in order as possible. A candidate with enough of the template's words is a match, and the
words before and behind it are aligned again, so that each of several occurrences is found.

The index is as large as the templates, which are given, so it goes along with the tasks; documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.llm import hashing
from corpusgrid.llm.tokens import slices

WINDOW, WINNOW, BAND, COVERAGE = 3, 2, 6, 0.75

# Notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_FOLD = np.array([32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def winnow(hashes: np.ndarray, width: int = WINNOW) -> np.ndarray:
    """Places of the smallest of each `width` neighbours, the rightmost among equals; all neighbours if there are fewer."""
    if not len(hashes):
        return np.zeros(0, int)
    width = min(width, len(hashes))
    view = np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1]
    return np.unique(np.arange(len(view)) + width - 1 - view.argmin(axis=1))


class Index:
    """The inverted index of the templates."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        self.names = list(templates)
        self.words = [hashing.words(_FOLD[np.frombuffer(t.encode(), np.uint8)])[2] for t in templates.values()]
        found = []
        for i, words in enumerate(self.words):
            grams = hashing.windows(words, WINDOW)
            found += [(int(grams[p]), i, int(p)) for p in winnow(grams)]
        found.sort()
        self.hashes = np.array([h for h, _, _ in found], np.uint64)
        self.template, self.place = np.array([t for _, t, _ in found]), np.array([p for _, _, p in found])

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among grams, entry of the index) of every hit."""
        left, right = np.searchsorted(self.hashes, grams, "left"), np.searchsorted(self.hashes, grams, "right")
        at = np.flatnonzero(left < right)
        n = right[at] - left[at]
        return np.repeat(at, n), np.repeat(left[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND, low: int = 0, high: int | None = None) -> tuple[int, int, int]:
    """(equal words, first, last) of the longest common subsequence within the band: template word i meets document
    words i + diagonal - band .. i + diagonal + band. first and last are the document's words at its ends.
    Only the document's words low .. high - 1 count."""
    high = len(words) if high is None else high
    width = 2 * band + 1
    before = [(0, -1, -1)] * (width + 1)  # (matches, first, last) for offsets of the row above
    best = (0, -1, -1)
    for i, w in enumerate(template):
        row, left = [], (0, -1, -1)
        for o in range(width):
            j = i + diagonal - band + o
            up, slant = before[o + 1], before[o]
            here = max(up, left, key=lambda x: (x[0], x[1]))
            if low <= j < high and words[j] == w:
                here = max(here, (slant[0] + 1, slant[1] if slant[0] else j, j), key=lambda x: (x[0], x[1]))
            row.append(here)
            left = here
            best = max(best, here, key=lambda x: (x[0], x[1] - x[2]))
        before = [*row, (0, -1, -1)]
    return best


def occurrences(template: np.ndarray, words: np.ndarray, diagonal: int, band: int, need: float) -> list[tuple[int, int, int]]:
    """(equal words, first, last) of all matches of `need` words within the band: the best, then those before and behind it."""
    out, left = [], [(max(0, diagonal - band), min(len(words), diagonal + len(template) + band))]
    while left:
        low, high = left.pop()
        if high - low < need:
            continue
        n, first, last = align(template, words, diagonal, band, low, high)
        if n >= need:
            out.append((n, first, last))
            left += [(low, first), (last + 1, high)]
    return out


def scan(words: np.ndarray, grams: np.ndarray, index: Index, coverage: float = COVERAGE, band: int = BAND) -> list[tuple[str, int, float, int, int]]:
    """Matches (license, equal words, share of the template, first word, last word) in one document, in order.

    Of matches that overlap, the one of more equal words stays, then of the larger share, then of the smaller name, then the shorter one.
    """
    at, entry = index.hits(grams)
    found = []
    if len(at):
        template, diagonal = index.template[entry], at - index.place[entry]
        order = np.lexsort((diagonal, template))
        before = (-1, 0)  # template and first diagonal of the candidate
        for t, d in zip(template[order].tolist(), diagonal[order].tolist(), strict=True):
            if t == before[0] and d - before[1] <= band:
                continue
            before = (t, d)
            own = index.words[t]
            found += [(index.names[t], n, round(n / len(own), 6), first, last) for n, first, last in occurrences(own, words, d, 2 * band, coverage * len(own))]
    found = sorted(set(found), key=lambda m: (-m[1], -m[2], m[0], m[4] - m[3], m[3]))
    kept: list[tuple[str, int, float, int, int]] = []
    taken = np.zeros(len(words), bool)
    for m in found:
        if not taken[m[3] : m[4] + 1].any():
            taken[m[3] : m[4] + 1] = True
            kept.append(m)
    return sorted(kept, key=lambda m: m[3])


def license_scan(docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = COVERAGE, band: int = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and matches: array of (license, words, coverage, first_word, last_word, start, end), for every row.

    start and end are code points of the text. Null or empty text: no matches. Null or repeated ids are rows like others.
    """
    templates = dict(TEMPLATES if templates is None else templates)
    match = T.StructType([
        T.StructField("license", T.StringType()), T.StructField("words", T.LongType()), T.StructField("coverage", T.DoubleType()),
        *(T.StructField(c, T.LongType()) for c in ("first_word", "last_word", "start", "end")),
    ])
    schema = T.StructType([docs.schema[id_col], T.StructField("matches", T.ArrayType(match))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        index, target = Index(templates), to_arrow_schema(schema)
        for batch in batches:
            for a, b in slices(batch.column(1), 4 << 20):
                texts = batch.column(1).slice(a, b - a)
                out: list[list[dict]] = [[] for _ in range(b - a)]
                data, begin = hashing.joined(texts, _FOLD)
                starts, _, words = hashing.words(data)
                first = np.searchsorted(starts, begin)
                seen = np.unique(np.searchsorted(first, index.hits(hashing.windows(words, WINDOW))[0], side="right") - 1)
                for d in seen:
                    own = data[begin[d] : begin[d + 1]]
                    s, e, own = hashing.words(own)
                    points = np.cumsum((np.frombuffer(texts[int(d)].as_buffer(), np.uint8) & 0xC0) != 0x80)
                    for name, n, share, i, j in scan(own, hashing.windows(own, WINDOW), index, coverage, band):
                        out[d].append({"license": name, "words": n, "coverage": share, "first_word": i, "last_word": j, "start": int(points[s[i]]) - 1, "end": int(points[e[j] - 1])})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, target.field("matches").type)], schema=target)

    return docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    each = lambda f: F.transform("matches", f)
    return out.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(each(lambda m: m["license"]), "; ").alias("licenses"),
        F.coalesce(F.array_max(each(lambda m: m["coverage"])), F.lit(0.0)).alias("best_coverage"),
        F.array_join(each(lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), "; ").alias("spans"),
    )
