"""Licence scans: exact phrase places plus a set-similarity join of text blocks
with licence templates.

Base: places where the words of a phrase stand consecutively.  Method: the
blocks of a text are, for each template of L words, the windows of 2 L words at
every ceil(L / 2)-th word, across line ends, so a notice wrapped or padded to 1.5
times its length lies in one whole; words further apart than that are no match.
Block and template are sets of words in one
global order, rarest first (document frequencies over all input texts, ties by
hash).  A block meets a template when it holds at least ``containment`` of the
template's words.  Such a pair must share a word inside the template's prefix
(its |T| - o + 1 rarest words, o = ceil(containment |T|)); only windows around
such words are looked at.  Blocks of fewer words fall to the length
filter, pairs whose first shared prefix word leaves too few words behind it on either
side to the positional filter; the rest is counted exactly.  No filter loses a pair.

Only template words have a place in the order that matters: a block's other
words can be in no intersection and rank behind none of them, so the block is
reduced to its template words once its length is known.

Defined results: null or empty text has no words, counts of 0, null places,
empty labels and score 0; repeated rows repeat their result; other input
columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.textcore import ALNUM_WORDS, U64, Lookup, Words, ranges, signed, slices, utf8, word_hash

#: Phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Licence notices and licence texts (fixed values): label, text.  Digits stand for version numbers.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software. The Software is provided as is, without warranty of any kind, express or implied, including but not "
            "limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event "
            "shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action "
            "of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other "
            "dealings in the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in "
               "writing, software distributed under the License is distributed on an as is basis, without warranties or "
               "conditions of any kind, either express or implied. See the License for the specific language governing "
               "permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but without any warranty; without even the "
            "implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for "
            "more details."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
            "and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
CONTAINMENT = 0.8


def _words(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    return Words(b, np.array([0, len(b)], dtype=np.int64), ALNUM_WORDS).hash


def _runs(batch, col: int):
    data, off = utf8(batch.column(col))
    for lo, hi in slices(off):
        yield lo, hi, Words(data, off[lo:hi + 1], ALNUM_WORDS)


def template_frequencies(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[int, int]:
    """Documents that hold each template word (one count a template word reaches the driver)."""
    vocab = np.unique(np.concatenate([_words(t) for _, t in templates]))

    def count(batches: Iterator[pa.RecordBatch]):
        find = Lookup(vocab, 16)
        total = np.zeros(len(vocab), dtype=np.int64)
        for batch in batches:
            for _, hi, w in _runs(batch, 0):
                pos, idx = find.find(w.hash)
                seen = np.unique(w.doc[pos] * len(vocab) + idx)
                total += np.bincount(seen % len(vocab), minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(signed(vocab)), pa.array(total)], names=["w", "n"])

    got = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    out = {int(v): 0 for v in vocab}
    for r in got.collect():
        out[r["w"] & (2 ** 64 - 1)] = r["n"]
    return out


class TemplateJoin:
    """Templates as word sets in the global order, with an index over their prefixes."""

    def __init__(self, templates, frequency: dict[int, int], containment: float):
        order = sorted(frequency, key=lambda w: (frequency[w], w))
        self.vocab = np.array(sorted(frequency), dtype=U64)
        rank = {w: r for r, w in enumerate(order)}
        self.rank = np.array([rank[int(w)] for w in self.vocab], dtype=np.int64)
        self.find = Lookup(self.vocab, 16)
        self.labels, self.sets, self.need, self.places, self.size, self.prefix = [], [], [], [], [], []
        for label, text in templates:
            words = _words(text)
            s = sorted({rank[int(w)] for w in words})
            o = math.ceil(containment * len(s) - 1e-9)
            self.labels.append(label), self.sets.append(s), self.need.append(o), self.size.append(len(words))
            self.places.append({r: j for j, r in enumerate(s)})
            inside = np.zeros(len(order), dtype=bool)
            inside[s[:len(s) - o + 1]] = True
            self.prefix.append(inside)
        self.in_prefix = np.logical_or.reduce(self.prefix)

    def match(self, i: int, ranks: list[int], size: int) -> float:
        """Containment of template ``i`` in a block of ``size`` words whose template
        words have the ascending ``ranks``; 0 below the threshold."""
        o, t, places = self.need[i], self.sets[i], self.places[i]
        if size < o:
            return 0.0
        for j, r in enumerate(ranks):
            if r in places:  # the first shared word must be in the prefix and leave enough behind it
                if not self.prefix[i][r] or 1 + min(len(t) - places[r] - 1, len(ranks) - j - 1) < o:
                    return 0.0
                break
        both = sum(r in places for r in ranks)
        return both / len(t) if both >= o else 0.0

    def blocks(self, w: Words):
        """(text of the run, template, first word, containment) of every window that meets its template."""
        pos, idx = self.find.find(w.hash)
        rank = self.rank[idx]
        rare = np.flatnonzero(self.in_prefix[rank])
        for i in range(len(self.sets)) if len(rare) else ():
            p = pos[rare[self.prefix[i][rank[rare]]]]
            if not len(p):
                continue
            wide, step = 2 * self.size[i], -(-self.size[i] // 2)
            doc = w.doc[p]
            place = p - w.first[doc]
            last = place // step
            first = np.maximum(0, -(-(place - wide + 1) // step))
            each = np.unique(np.repeat(doc, last - first + 1) * (1 << 40) + ranges(first, last - first + 1))
            for d, k in zip((each >> 40).tolist(), (each & ((1 << 40) - 1)).tolist()):
                a = int(w.first[d]) + k * step
                z = min(a + wide, int(w.first[d + 1]))
                lo, hi = np.searchsorted(pos, [a, z])
                if hi - lo >= self.need[i]:
                    share = self.match(i, np.unique(rank[lo:hi]).tolist(), z - a)
                    if share:
                        yield d, i, k * step, share


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, phrases=PHRASES, templates=TEMPLATES,
         containment: float = CONTAINMENT, frequency: dict[int, int] | None = None) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks
    (windows that meet a template: its number, the window's first word, containment)."""
    phrases, templates = dict(phrases), list(templates)
    frequency = template_frequencies(docs, templates, text_col) if frequency is None else frequency
    targets = [([word_hash(w) for w in p.split(" ")], label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]):
        join = TemplateJoin(templates, frequency, containment)
        for batch in batches:
            n = batch.num_rows
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            base, found = [set() for _ in range(n)], [[] for _ in range(n)]
            for lo, hi, w in _runs(batch, 1):
                n_words[lo:hi] = np.diff(w.first)
                for hashes, label in targets:
                    k = len(hashes)
                    at = np.flatnonzero(w.hash[:max(0, len(w.hash) - k + 1)] == U64(hashes[0]))
                    for j in range(1, k):
                        at = at[w.hash[at + j] == U64(hashes[j])]
                    at = at[w.doc[at] == w.doc[at + k - 1]]
                    for a in at.tolist():
                        d = int(w.doc[a])
                        place = a - int(w.first[d])
                        d += lo
                        n_base[d] += 1
                        first[d] = place if first[d] < 0 else min(first[d], place)
                        last[d] = max(last[d], place)
                        base[d].add(label)
                for d, i, start, share in join.blocks(w):
                    found[lo + d].append({"template": i, "first_word": start, "share": share})
            labels = [sorted(b | {join.labels[f["template"]] for f in fs}) for b, fs in zip(base, found)]
            score = [1.0 if b else max((f["share"] for f in fs), default=0.0) for b, fs in zip(base, found)]
            place = lambda x: pa.array(x, pa.int64(), mask=x < 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_base), place(first), place(last),
                 pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(x) for x in labels]),
                 pa.array(score, pa.float64()),
                 pa.array(found, pa.list_(pa.struct([("template", pa.int32()), ("first_word", pa.int64()), ("share", pa.float64())])))],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, "id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                               "base_labels string, labels string, score double, "
                               "blocks array<struct<template:int,first_word:bigint,share:double>>").withColumnRenamed("id", id_col)
