"""Licence scan: a positional index of rare licence words.

Every template (a notice or a clause of a licence, or a base phrase) is a
list of words with mandatory key phrases; all of a base phrase is mandatory.
The rarest words of the key phrases, by document frequency over the whole
corpus, are posted with their offsets. A document's words are looked up in
the postings; an occurrence proposes an alignment (template, start), and only
alignments that all of a template's posted words propose are kept. As the key
phrases must stand at their places, no place that can hold is passed over.
There the template's words are compared place by place, by their bytes: the
key phrases must be whole, and `min_coverage` of all words must agree. An
alignment may begin before or end after the text.

Words are runs of digits, letters a-z after lower-casing A-Z, and all other
characters from U+0080. A null text counts as empty: no words, no labels,
score 0. Rows are judged one by one, so repeated rows repeat their result.
Other columns, whatever their names, are ignored. The score is the best
coverage among the labels given, 1 for a base phrase, 0 without a label.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylark.llm.bytescan import ALNUM, LOWER, hash_bytes, hash_spans, runs, slices, split_words
from quarrylark.llm.shared import bounded_batches

ANCHORS = 2
MIN_COVERAGE = 0.7

#: (label, phrase)
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: (label, notice, mandatory key phrases)
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "this program is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-any", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "released under the creative commons zero cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    # clauses of whole licence texts
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["on an as is basis"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ["merge publish distribute sublicense"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["substantial portions of the software"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission notice appear in all copies"]),
    ("gpl-any", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["in the hope that it will be useful"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ["altered source versions must be plainly marked"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["accompanying documentation covered by this license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ["eclipse public license"]),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", ["unauthorized copying"]),
]


def _words(text: str) -> list[bytes]:
    return split_words(text.lower().encode(), ALNUM)


class _Template:
    def __init__(self, label: str, text: str, keys: list[str] | None):
        self.label, self.base = label, keys is None
        self.words = _words(text)
        self.bytes = b" ".join(self.words)
        self.hashes = np.array([hash_bytes(w) for w in self.words], np.uint64)
        must = np.zeros(len(self.words), bool)
        for key in keys or []:
            part = _words(key)
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(part)] == part)
            must[at : at + len(part)] = True
        self.must = np.ones(len(self.words), bool) if self.base else must
        self.anchors: list[int] = []

    def choose(self, documents_with: dict[bytes, int], most: int) -> None:
        """Offsets of the rarest mandatory words; ties go to the longer, then the first."""
        rank = sorted(np.flatnonzero(self.must).tolist(), key=lambda i: (documents_with.get(self.words[i], 0), -len(self.words[i]), i))
        self.anchors = rank[:most]


class Index:
    """Templates with their anchors posted under the anchors' hashes."""

    def __init__(self, documents_with: dict[bytes, int] | None = None, base=BASE, notices=NOTICES, anchors: int = ANCHORS):
        self.templates = [_Template(a, p, None) for a, p in base] + [_Template(*n) for n in notices]
        self.vocabulary = sorted({w for t in self.templates for w in t.words})
        self.posted: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            t.choose(documents_with or {}, anchors)
            for at in t.anchors:
                self.posted[int(t.hashes[at])].append((k, at))
        self.keys = np.array(sorted(self.posted), np.uint64)

    def places(self, words: np.ndarray, row_at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yield (template, starts, rows) where all key phrases' hashes stand."""
        slot = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        found = np.flatnonzero(self.keys[slot] == words)
        row = np.searchsorted(row_at, found, "right") - 1
        slot, proposed, rows = slot[found], defaultdict(list), len(row_at)
        for n in np.unique(slot).tolist():
            here = slot == n
            for k, at in self.posted[int(self.keys[n])]:
                # one number for start and row; a start may lie before its row
                proposed[k].append((found[here] - at) * rows + row[here])
        for k, parts in sorted(proposed.items()):
            t = self.templates[k]
            if len(parts) < len(t.anchors):
                continue
            both = parts[0]
            for part in parts[1:]:
                both = np.intersect1d(both, part, assume_unique=True)
            start, of = both // rows, both % rows
            good = np.ones(len(start), bool)
            for j in np.flatnonzero(t.must).tolist():
                at = start + j
                good &= (at >= row_at[of]) & (at < row_at[of + 1])
                good[good] = words[at[good]] == t.hashes[j]
            if good.any():
                yield k, start[good], of[good]


def _sliced(batches):
    for batch in batches:
        for first, end, raw, offs in slices(batch.column(batch.schema.names.index("text"))):
            data = LOWER[raw]
            starts, ends, row_at = runs(data, offs, ALNUM)
            yield batch, first, end, data, starts, ends, row_at, hash_spans(data, starts, ends)


def document_frequency(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the (bounded) vocabulary stands."""
    hashes = np.array([hash_bytes(w) for w in vocabulary], np.uint64)
    order = np.argsort(hashes)
    keys = hashes[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for _, _, _, _, _, _, row_at, words in _sliced(batches):
            slot = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
            found = np.flatnonzero(keys[slot] == words)
            row = np.searchsorted(row_at, found, "right") - 1
            total += np.bincount(np.unique(row * len(keys) + slot[found]) % len(keys), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(order.astype(np.int64)), pa.array(total)], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r.word]: r.n for r in rows}


def _coverage(t: _Template, start: int, row: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row_at: np.ndarray) -> float:
    """The share of the template's words that stand at their places; 0 where
    a mandatory one doesn't."""
    low, high = max(start, int(row_at[row])), min(start + len(t.words), int(row_at[row + 1]))
    same = np.zeros(len(t.words), bool)
    for p in range(low, high):
        same[p - start] = data[starts[p] : ends[p]].tobytes() == t.words[p - start]
    return float(same.mean()) if same[t.must].all() else 0.0


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, min_coverage: float = MIN_COVERAGE, anchors: int = ANCHORS, base=BASE, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    plain = Index(None, base, notices, anchors)
    index = Index(document_frequency(docs, plain.vocabulary), base, notices, anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, end, data, starts, ends, row_at, words in _sliced(batches):
            n = end - first
            n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base_said, said = [set() for _ in range(n)], [set() for _ in range(n)]
            score = np.zeros(n)
            for k, at, row in index.places(words, row_at):
                t = index.templates[k]
                coverage = np.array([_coverage(t, p, r, data, starts, ends, row_at) for p, r in zip(at.tolist(), row.tolist(), strict=True)])
                good = coverage >= (1 if t.base else min_coverage)
                at, row = at[good], row[good]
                np.maximum.at(score, row, coverage[good])
                for r in np.unique(row).tolist():
                    said[r].add(t.label)
                    if t.base:
                        base_said[r].add(t.label)
                if t.base:
                    place = at - row_at[row]
                    n_base += np.bincount(row, minlength=n)
                    np.minimum.at(low, row, place)
                    np.maximum.at(high, row, place)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, n), pa.array(np.diff(row_at)), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none),
                    pa.array([",".join(sorted(x)) for x in base_said], pa.string()), pa.array([",".join(sorted(x)) for x in said], pa.string()), pa.array(score),
                ],
                names=["doc_id", *(c.split()[0] for c in _SCHEMA.split(", "))],
            )

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def op1(spark, sf_dir: str) -> DataFrame:
    from quarrylark.llm.shared import table

    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql_templates() -> str:
    """The templates as rows: label, base, words, the key's place and the key."""
    rows = []
    for label, text, keys in [*((a, p, None) for a, p in BASE), *NOTICES]:
        words, key = text.split(), (keys or [text])[0]
        k = key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        rows.append(f"('{label}', {str(keys is None).lower()}, {words!r}, {at}, {len(k)}, '{key}')")
    return ", ".join(rows)


#: Key phrases found word by word, then all words of their templates compared.
SQL = rf"""
WITH t(label, base, words, key_at, key_len, key) AS (VALUES {_sql_templates()}), lens AS (SELECT DISTINCT key_len FROM t),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT r, w, i, key_len, array_to_string(w[i:i + key_len - 1], ' ') AS key FROM p, lens WHERE i + key_len - 1 <= len(w)),
o AS (SELECT s.r, s.w, t.label, t.base, t.words, s.i - t.key_at AS start FROM s JOIN t ON s.key = t.key AND s.key_len = t.key_len),
c AS (
  SELECT r, label, base, start, len(list_filter(range(1, len(words) + 1), lambda j: CASE WHEN start + j - 1 BETWEEN 1 AND len(w) THEN w[start + j - 1] = words[j] ELSE false END)) / len(words) AS coverage
  FROM o
), g AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) - 1 AS first_word, max(start) FILTER (base) - 1 AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(coverage) AS score
  FROM c WHERE coverage >= CASE WHEN base THEN 1 ELSE {MIN_COVERAGE} END GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""
