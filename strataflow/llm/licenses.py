"""Licence scans: TF-IDF cosine of headers and licence files to templates, inherited down directories."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept
from .frames import map_rows

# Notices by which works name their licence.  Several texts may stand for one licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal, Public Domain Dedication."),
)
# A header holds one of these words; every template does.
MARKS = r"licen[cs]e|redistribut|permission is hereby|public domain"
THRESHOLD = 0.6
FILE_SHARE = 0.5
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
MARKED = re.compile(MARKS, re.IGNORECASE)
LINES = re.compile(r"[^\n\r]+")
# Comment marks at the edges of a line, and names of licence files.
COMMENT = re.compile(r"^\s*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|\"\"\"|\'\'\')\s?")
COMMENT_END = re.compile(r"\s*(?:\*+/|-->|\"\"\"|\'\'\')\s*$")
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying)([._-][^/]*)?$"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Scorer:
    """Sparse TF-IDF vectors of the templates.

    A term that no template has counts as if one document had it.
    """

    def __init__(self, frequency: dict[str, int], documents: int, templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        self.most = math.log(1 + documents) + 1.0
        self.weight = {t: math.log((1 + documents) / max(n, 1)) + 1.0 for t, n in frequency.items()}
        vectors = [self.vector(text) for _, text in templates]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for number, vector in enumerate(vectors):
            for term, value in vector.items():
                self.postings.setdefault(term, []).append((number, value))

    def vector(self, text: str) -> dict[str, float]:
        counts: dict[str, float] = {}
        for term in terms(text):
            counts[term] = counts.get(term, 0.0) + 1.0
        raw = {t: (1 + math.log(n)) * self.weight.get(t, self.most) for t, n in counts.items()}
        length = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        return {t: v / length for t, v in raw.items()}

    def best(self, text: str) -> tuple[str | None, float]:
        """Licence of the most alike template (the first on ties) and its cosine."""
        score = np.zeros(len(self.names))
        for term, value in self.vector(text).items():
            for number, other in self.postings.get(term, ()):
                score[number] += value * other
        at = int(score.argmax())
        return (self.names[at], min(1.0, float(score[at]))) if score[at] > 0 else (None, 0.0)

    def header(self, text: str | None) -> tuple[str | None, float, float, float]:
        """Best licence of a text, its cosine, the share of the text's words in marked lines, and the cosine of the whole.

        Scored are marked lines, marked passages and the whole text; the first of the highest cosine wins.
        """
        found, score, inside, every = None, 0.0, 0, 0
        if not text or not MARKED.search(text):
            return None, 0.0, 0.0, 0.0
        for line in LINES.finditer(text):
            n = len(line[0].split())
            every += n
            if MARKED.search(line[0]):
                inside += n
                name, value = self.best(line[0])
                if value > score:
                    found, score = name, value
        joined = passages(text)
        whole_name, whole = self.best(" ".join(joined[0]))
        for name, value in [*(self.best(p) for p in joined[1] if MARKED.search(p)), (whole_name, whole)]:
            if value > score:
                found, score = name, value
        return found, score, inside / every if every else 0.0, whole


def passages(text: str) -> tuple[list[str], list[str]]:
    """Lines without comment marks; and passages of joined lines: between empty lines, and the leading comment block."""
    plain, blocks, block, leading, in_front = [], [], [], [], True
    for line in text.splitlines():
        bare = COMMENT_END.sub("", COMMENT.sub("", line)).strip()
        plain.append(bare)
        if in_front and (not line.strip() or COMMENT.match(line)):
            leading.append(bare)
        else:
            in_front = False
        if bare:
            block.append(bare)
        elif block:
            blocks.append(" ".join(block))
            block = []
    return plain, [*blocks, " ".join(block), " ".join(leading)]


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many documents each template term occurs, over all documents; and their number."""
    wanted = {t for _, text in templates for t in terms(text)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        rows = 0
        for batch in batches:
            rows += len(batch)
            for text in batch["text"]:
                for t in wanted.intersection(terms(text or "")):
                    seen[t] = seen.get(t, 0) + 1
        yield pd.DataFrame({"term": ["", *seen], "n": [rows, *seen.values()]})

    counted = docs.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}  # at most one row per template term
    total = found.pop("", 0)
    return {t: found.get(t, 0) for t in wanted}, total


def directory(path):
    """Directory of a path, '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(docs: DataFrame, path: str = "path", threshold: float = THRESHOLD, file_share: float = FILE_SHARE, with_text: bool = True) -> DataFrame:
    """Adds ``license, license_score, license_from`` and ``license_dir`` to each row.

    A row whose best header reaches ``threshold`` has its own licence (from "header", or "file" if the whole
    text reaches it too, or at least ``file_share`` of its words lie in licence lines, or its name is that of
    a licence file).  Licence files speak for their directory and all
    below: a row without own licence takes that of the nearest ancestor directory that has one (from
    "inherited"), else none (from "none").  Several files of one directory: the highest score, then the
    first licence in order.

    Null and empty texts have no licence of their own; a null path is in no directory and inherits nothing;
    repeated rows get the same; columns of ``docs`` by those names are replaced.  Very long texts are scored whole.
    Without ``with_text`` the texts are left out of the result, and of the table that is kept on the way.
    """
    frequency, total = document_frequencies(docs)
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(frequency, total))
    added = ["license", "license_score", "license_from", "license_dir"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([scorer.value.header(t) for t in batch["text"]], columns=["_name", "_score", "_share", "_whole"])

    base = docs.drop(*added).withColumn("_dir", directory(F.col(path)))
    scored = map_rows(base, run, "_name string, _score double, _share double, _whole double", reads=["text"])
    marked = kept(scored if with_text else scored.drop("text"))
    own = F.col("_score") >= threshold
    named = F.coalesce(F.col(path).rlike(FILE_NAME), F.lit(False))
    file = own & ((F.col("_share") >= file_share) | (F.col("_whole") >= threshold) | named)
    files = (
        marked.filter(file & F.col("_dir").isNotNull())
        .groupBy(F.col("_dir").alias("_home"))
        .agg(F.min_by(F.struct("_name", "_score"), F.struct(-F.col("_score"), "_name")).alias("_file"))
    )
    # One row per directory, never per document, is compared with its ancestors.
    parts = F.split("_dir", "/")
    ancestors = F.concat(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit(""))
    )
    nearest = (
        marked.select("_dir").dropna().distinct()
        .select("_dir", F.explode(F.array_distinct(ancestors)).alias("_home"))
        .join(files, "_home")
        .groupBy("_dir")
        .agg(F.max_by(F.struct("_home", "_file"), F.length("_home")).alias("_near"))
    )
    joined = marked.join(nearest, "_dir", "left")
    near = F.col("_near._file._name")
    return joined.select(
        *[F.col(c) for c in docs.drop(*added, *([] if with_text else ["text"])).columns],
        F.when(own, F.col("_name")).otherwise(near).alias("license"),
        F.when(own, F.col("_score")).otherwise(F.col("_near._file._score")).alias("license_score"),
        F.when(file, "file").when(own, "header").when(near.isNotNull(), "inherited").otherwise("none").alias("license_from"),
        F.when(own, F.col("_dir")).otherwise(F.col("_near._home")).alias("license_dir"),
    )
