"""License scan: passages of each text against licence templates by Dice coefficient over word bigrams.

Passages are the whole text, its paragraphs (between blank lines) and its lines. Normalising lower-cases and keeps runs of
letters and digits. Templates are notices and short licences below, and whole licence texts in ``license_texts``. With bigram counts a and b the coefficient is 2 * shared / (a + b), so at threshold t only templates with
t / (2 - t) * b <= a <= (2 - t) / t * b can match, and of those only templates with a passage's bigram among their rarest ones, as many
as can't all be missing at the threshold: others are never compared.

Defined cases: null and empty texts have no passages; a passage of one word has that word as its only gram; a passage that is
both line and paragraph is reported once, as a line; repeated rows are scanned one by one; equal scores go to the first
template by name.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

THRESHOLD = 0.8
#: Notices by licence, as licensors ask for them, and short licence texts.
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause/notice": "Licensed under the BSD 3-Clause License",
    "CC-BY-4.0/notice": "This work is licensed under the Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT/notice": "Released under the MIT License",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
WORDS = re.compile(r"[^\W_]+")


def grams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter([(w,) for w in words])


def dice(a: Counter, b: Counter) -> float:
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) if a or b else 0.0


#: Whole licence texts, as their licensors publish them: the template's name is the file's.
TEXTS = Path(__file__).parent / "license_texts"


def templates() -> dict[str, str]:
    return TEMPLATES | {p.stem: p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}


class Templates:
    """Templates by their rare grams and sizes, to ask only those that can reach the threshold."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold = threshold
        self.grams = {k: g for k, t in texts.items() if (g := grams(WORDS.findall(t.lower())))}
        self.size = {k: sum(g.values()) for k, g in self.grams.items()}
        in_templates = Counter(x for g in self.grams.values() for x in g)
        factor = threshold / (2 - threshold)
        self.sizes = {n for size in self.size.values() for n in range(int(size * factor), int(size / factor) + 2) if factor * size <= n <= size / factor}
        self.by_gram: dict[tuple, list[str]] = {}
        for name, g in self.grams.items():
            # at the threshold a passage of a grams shares t / 2 * (a + b) of b, with a >= factor * b: fewer are missing than this
            missing, size = 0, self.size[name]
            for x in sorted(g, key=lambda x: (in_templates[x], x)):
                self.by_gram.setdefault(x, []).append(name)
                missing += g[x]
                if missing > size - threshold / 2 * (1 + factor) * size + 1e-9:
                    break
        self.starts = {x[0] for x in self.by_gram}

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """The most similar template at the threshold: (score, name); equal scores go to the first name."""
        size = max(len(words) - 1, min(len(words), 1))
        if size not in self.sizes or self.starts.isdisjoint(words):
            return None
        pairs = zip(words, words[1:], strict=False) if len(words) > 1 else [(words[0],)]
        asked = {n for x in self.by_gram.keys() & set(pairs) for n in self.by_gram[x]}
        asked = [n for n in asked if self.threshold * (self.size[n] + size) <= 2 * min(self.size[n], size) + 1e-9]
        if not asked:
            return None
        own = grams(words)
        score, name = min((-dice(own, self.grams[n]), n) for n in asked)
        return (-score, name) if -score >= self.threshold else None


def passages(text: str):
    """(kind, first line, words) of the lines, of paragraphs of more lines, and of the whole text where it is more than one paragraph."""
    lines = [WORDS.findall(x) for x in text.lower().split("\n")]
    held, first, blocks = [], 0, 0
    for k, w in enumerate([*lines, []]):
        if w:
            yield "line", k, w
            if not held:
                first = k
            held.append(w)
        elif held:
            blocks += 1
            if len(held) > 1:
                yield "paragraph", first, [x for h in held for x in h]
            held = []
    if blocks > 1:
        yield "text", 0, [x for w in lines for x in w]


def scan(docs: DataFrame, texts: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id and ``found``, an array of (template, kind, line, score). ``texts``: the templates, by name."""
    texts = templates() if texts is None else texts
    source = docs.select("doc_id", "text")
    found = T.ArrayType(T.StructType([T.StructField("template", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("template", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        ask = Templates(texts, threshold)
        for b in batches:
            out = []
            for text in b.column("text"):
                rows = []
                for kind, line, words in passages(text.as_py() or ""):
                    if hit := ask.best(words):
                        rows.append({"template": hit[1], "kind": kind, "line": line, "score": hit[0]})
                out.append(rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, arrow)], names=["doc_id", "found"])

    return source.mapInArrow(run, source.select("doc_id").schema.add("found", found))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(read_table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: F.split(x["template"], "/")[0])))
    return out.select("doc_id", F.size("found").cast("long").alias("n_passages"), F.array_join(names, ",").alias("licenses"), F.round(F.array_max(F.transform("found", lambda x: x["score"])), 6).alias("best_score"), "found")
