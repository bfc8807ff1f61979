"""License scans by patience alignment.

A text and a template are aligned on words that occur once in both: of these, the longest run that is increasing in
both (patience sorting) is fixed, then the gaps between them are aligned in the same way, and ends that agree word by
word are taken along. Coverage is the share of the template's words that are matched. Texts are searched in windows: a
window starts at a word that is typical of the template and is half as long again as the template; after a match the search goes
on behind it. Templates of whose words too few are in the text to reach the wanted coverage are passed over, which can't lose one.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters.
Defined cases: null and wordless texts have no license. Overlapping matches: the one with more matched words stays, then the higher
coverage, then the name that comes first. Whole texts of any length are searched; repeated licenses are found each time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import map_texts, table
from lectern.llm.decontaminate import item_words

COVERAGE = 0.85

#: Names and notices of public licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Words too common to start a window.
COMMON = frozenset(b"a an and any are as at by for from in is it of on or that the this to under with you".split())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (a, b) sorted by a that is increasing in b, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
        back.append(piles[at - 1] if at else -1)
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched positions of a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        where = {b[y]: y for y in range(k, m) if cb[b[y]] == 1}
        anchors = _increasing([(x, where[a[x]]) for x in range(i, j) if ca[a[x]] == 1 and a[x] in where])
        if not anchors:
            continue
        pi, pk = i, k
        for x, y in anchors:
            out.append((x, y))
            gaps.append((pi, x, pk, y))
            pi, pk = x + 1, y + 1
        gaps.append((pi, j, pk, m))
    return sorted(out)


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = [(name, item_words(text.encode())) for name, text in templates]
        self.templates = [(n, w) for n, w in self.templates if w]
        self.typical = [frozenset(w) - COMMON or frozenset(w) for _, w in self.templates]
        self.any = frozenset().union(*self.typical) if self.typical else frozenset()

    def scan(self, words: list[bytes]) -> list[dict]:
        if self.any.isdisjoint(words):
            return []
        present = set(words)
        found = []
        for (name, template), typical in zip(self.templates, self.typical):
            if sum(w in present for w in template) < self.coverage * len(template):
                continue
            n = len(template)
            lead = next(i for i, w in enumerate(template) if w in typical)
            size = n + n // 2 + 1
            free = 0
            for at, w in enumerate(words):
                if w not in typical or at < free:
                    continue
                start = max(free, at - lead)
                matched = patience(words[start : at + size], template)
                if matched and len(matched) >= self.coverage * n:
                    free = start + matched[-1][0] + 1
                    found.append({"license": name, "coverage": len(matched) / n, "matched": len(matched), "start": start + matched[0][0], "end": free})
        found.sort(key=lambda f: (-f["matched"], -f["coverage"], f["license"], f["start"]))
        kept: list[dict] = []
        for f in found:
            if all(f["end"] <= g["start"] or f["start"] >= g["end"] for g in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f["start"])


_MATCH = T.StructType().add("license", "string").add("coverage", "double").add("matched", "integer").add("start", "integer").add("end", "integer")


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, coverage: float = COVERAGE, keep: list[str] | None = None) -> DataFrame:
    """Append licenses: array of (license, coverage, matched words, start and end word), in the order of the text."""
    scanner = Scanner(templates, coverage)

    def fn(texts: list[bytes | None]):
        return ([scanner.scan(item_words(t)) for t in texts],)

    return map_texts(docs, text_col, fn, T.StructType().add("licenses", T.ArrayType(_MATCH)), keep)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    names = F.array_sort(F.array_distinct(F.col("licenses.license")))
    return found.select("doc_id", F.size("licenses").alias("n_matches"), F.array_join(names, ",").alias("license_names"), F.array_max("licenses.coverage").alias("best_coverage"), "licenses")
