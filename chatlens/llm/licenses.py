"""License scans: Dice coefficient over word bigrams between pieces of text and license templates.

Pieces are every line, every paragraph (lines between lines without words) and the whole text, normalised to words: A-Z
lower-cased, runs of a-z, 0-9 and non-ASCII characters. A piece fits a template when
``2 * common / (a + b) >= THRESHOLD`` over their sets of word bigrams (a single word stands for itself). From
the threshold follow bounds, size of the piece between ``t / (2 - t)`` and ``(2 - t) / t`` times that of the
template, which leave few candidate templates; only those are compared.

Templates are broadcast; their number is checked against ``MAX_TEMPLATES``, and longer lists are scanned in several passes of that many.

Defined cases: null texts and texts without words match nothing; templates without words are ignored; rows of one doc_id
are scanned one by one; other columns are ignored; ties of the best fit go to the alphabetically first license.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.base import text_slices
from chatlens.llm.decontaminate import words_of

THRESHOLD = 0.85
MAX_TEMPLATES = 5000  # broadcast at once; license texts of up to some 10 KB each

# Common public license notices and texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
     "and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
     "copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def bigrams(words: list[bytes]) -> set:
    return set(zip(words, words[1:])) if len(words) > 1 else {(w,) for w in words}


class Templates:
    """Bigram sets in order of size, for size bounds."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        sets = [(name, bigrams(words_of(text.encode()))) for name, text in templates]
        self.sets = sorted(((len(s), name, s) for name, s in sets if s), key=lambda x: x[:2])
        self.sizes = [x[0] for x in self.sets]
        self.threshold, self.ratio = threshold, threshold / (2 - threshold)
        self.least = min(self.sizes, default=0) * self.ratio

    def fits(self, piece: list[bytes]) -> list[tuple[str, float]]:
        if not piece or len(piece) < self.least:  # a piece has at most as many bigrams as words
            return []
        grams = bigrams(piece)
        n = len(grams)
        out = []
        for k in range(bisect_left(self.sizes, n * self.ratio - 1e-9), bisect_right(self.sizes, n / self.ratio + 1e-9)):
            size, name, other = self.sets[k]
            dice = 2.0 * len(grams & other) / (n + size)
            if dice >= self.threshold:
                out.append((name, dice))
        return out

    def scan(self, text: bytes) -> list[dict]:
        """Best fit of each license in the text's pieces, as ``license, dice, first_line, end_line``."""
        lines = [words_of(x) for x in text.split(b"\n")]
        pieces = [(i, i + 1) for i, w in enumerate(lines) if w]
        blank = [i for i, w in enumerate(lines) if not w]
        paragraphs = [(a + 1, b) for a, b in zip([-1, *blank], [*blank, len(lines)]) if b - a > 2]
        whole = [(0, len(lines))] if blank and len(paragraphs) != 1 or not paragraphs and len(pieces) > 1 else []
        best: dict[str, tuple] = {}
        for a, b in [*pieces, *paragraphs, *whole]:
            words = lines[a] if b - a == 1 else [w for x in lines[a:b] for w in x]
            for name, dice in self.fits(words):
                best[name] = max(best.get(name, (0.0,)), (dice, -a, -b))
        return [{"license": k, "dice": v[0], "first_line": -v[1], "end_line": -v[2]} for k, v in sorted(best.items())]


MATCH = "array<struct<license:string,dice:double,first_line:int,end_line:int>>"


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Return ``doc_id, matches`` for every row: one entry per license found, with its best piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("end_line", pa.int32())]))
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.array().cast(MATCH).alias("matches"))
    passes = range(0, max(1, len(templates)), MAX_TEMPLATES)
    for start in passes:
        tables = docs.sparkSession.sparkContext.broadcast(Templates(templates[start:start + MAX_TEMPLATES], threshold))

        def scan(batches, tables=tables, last=start == passes[-1]):
            for b, texts in text_slices(batches, "text"):
                found = [[*old, *tables.value.scan(t)] for old, t in zip(b.column("matches").to_pylist(), texts)]
                columns = [b.column("doc_id"), *([] if last else [b.column("text")]), pa.array(found, kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "matches"] if last else ["doc_id", "text", "matches"])

        out = out.mapInArrow(scan, f"doc_id {kind}, {'' if start == passes[-1] else 'text string, '}matches {MATCH}")
    return out


def document_licenses(docs: DataFrame) -> DataFrame:
    """Digest per row: number of licenses, the best with its coefficient, and all names in order."""
    best = F.element_at(F.array_sort("matches", lambda x, y: F.when(x["dice"] > y["dice"], -1).when(x["dice"] < y["dice"], 1)
                                     .when(x["license"] < y["license"], -1).when(x["license"] > y["license"], 1).otherwise(0)), 1)
    best = F.when(F.size("matches") > 0, best)
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return scan_licenses(docs).select("doc_id", F.size(names).cast("long").alias("n_licenses"), best["license"].alias("license"), best["dice"].alias("dice"),
                                      F.array_join(names, ",").alias("licenses"))
