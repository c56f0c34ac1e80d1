"""Licence notices in texts, found by an index of rare licence words with their positions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import materialize
from .flat import flat_bytes, slices


@dataclass(frozen=True)
class Passage:
    """A passage of a licence or of a usual reference to it, and the phrases that it can't do without."""

    label: str
    text: str
    keys: tuple[str, ...]


# Passages of well-known licences and of the notices that name them.
PASSAGES = (
    Passage("mit", "Released under the MIT License.", ("mit license",)),
    Passage("mit", "Licensed under the MIT License. See LICENSE in the project root for license information.", ("mit license",)),
    Passage("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("hereby granted free of charge", "associated documentation files")),
    Passage("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("permission notice shall be included", "substantial portions")),
    Passage("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Passage("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", ("apache license version 2 0", "except in compliance")),
    Passage("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("unless required by applicable law", "as is basis")),
    Passage("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Passage("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3 of the license")),
    Passage("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    Passage("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2 of the license")),
    Passage("lgpl-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu lesser general public license", "version 3 of the license")),
    Passage("lgpl-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", ("gnu lesser general public license", "version 2 1 of the license")),
    Passage("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu affero general public license", "version 3 of the license")),
    Passage("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("source code form", "mozilla public license v 2 0")),
    Passage("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    Passage("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products", "specific prior written permission")),
    Passage("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee", "appear in all copies")),
    Passage("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Passage("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    Passage("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Passage("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike 4 0",)),
    Passage("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Passage("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative commons attribution noncommercial 4 0",)),
    Passage("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0.", ("cc by nc sa 4 0",)),
    Passage("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0.", ("cc by nd 4 0",)),
    Passage("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("to the extent possible under law", "related or neighboring rights")),
    Passage("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software", "public domain")),
    Passage("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ("accompanying materials are made available", "eclipse public license 2 0")),
)

#: Phrases that give a label wherever their words stand side by side.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# A word is a run of digits, lower-case letters and characters beyond ASCII; upper case of ASCII is lowered, all else parts words.
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_in(data: bytes) -> list[bytes]:
    return data.translate(_TO_WORDS).split()


def _coded(column: pa.Array, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of all texts end to end, 0 for a word without one, and each text's number of words."""
    raw, starts = flat_bytes(column)
    data, found, size = raw.tobytes(), [], np.zeros(len(starts) - 1, np.int64)
    get = number.get
    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        words = words_in(data[a:b])
        size[k] = len(words)
        found.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
    return np.concatenate(found) if found else np.zeros(0, np.int32), size


def document_frequency(docs: DataFrame, words: list[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many of all rows each of ``words`` stands, and the number of rows. The words are those of the passages, so the counts are few."""
    number = {w: k for k, w in enumerate(words, 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words) + 1, np.int64)  # at 0: rows
        for batch in batches:
            for piece in slices(batch, "text"):
                codes, size = _coded(piece.column("text"), number)
                at = np.flatnonzero(codes)
                owner = np.searchsorted(np.cumsum(size), at, "right")
                met = np.unique(owner * (len(words) + 1) + codes[at]) % (len(words) + 1)
                total += np.bincount(met, minlength=len(words) + 1)
                total[0] += piece.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["word", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in materialize(counts, "frequencies").collect()}
    return {w: found.get(k, 0) for w, k in number.items()}, found.get(0, 0)


class RareWords:
    """The index: of each passage its ``rare`` words of the highest weight in the corpus, with their places in the passage."""

    def __init__(self, passages: tuple[Passage, ...], base: dict[str, str], frequency: dict[bytes, int], n_docs: int, rare: int = 8, share: float = 0.5):
        self.passages, self.base = passages, base
        texts = [words_in(p.text.encode()) for p in passages]
        every = sorted({w for t in texts for w in t} | {w for p in base for w in words_in(p.encode())} | {w for p in passages for k in p.keys for w in words_in(k.encode())})
        self.number = {w: k for k, w in enumerate(every, 1)}
        weight = {w: float(np.log((n_docs + 1) / (frequency.get(w, 0) + 1))) + 1e-9 for w in every}
        posts: list[tuple[int, int, int, float]] = []
        self.needed, self.total = np.zeros(len(passages), np.int64), np.zeros(len(passages))
        self.keys: list[list[tuple[np.ndarray, int]]] = []
        for k, (passage, words) in enumerate(zip(passages, texts, strict=True)):
            chosen = sorted(set(words), key=lambda w: (-weight[w], w))[:rare]
            own = [(self.number[w], k, i, weight[w]) for i, w in enumerate(words) if w in chosen]
            posts += own
            self.needed[k] = max(2, int(np.ceil(share * len(own))))
            self.total[k] = sum(p[3] for p in own)
            parts = [words_in(x.encode()) for x in passage.keys]
            self.keys.append([(np.array([self.number[w] for w in x]), next(i for i in range(len(words)) if words[i : i + len(x)] == x)) for x in parts])
        posts.sort()
        word, self.passage, self.place, self.weight = (np.array(c) for c in zip(*posts, strict=True))
        span = np.arange(len(every) + 2)
        self.first = np.searchsorted(word, span)
        self.phrases = [(np.array([self.number[w] for w in words_in(p.encode())]), label) for p, label in base.items()]

    @staticmethod
    def places(codes: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Where the phrase's words stand side by side."""
        at = np.flatnonzero(codes[: len(codes) - len(phrase) + 1] == phrase[0])
        for k in range(1, len(phrase)):
            at = at[codes[at + k] == phrase[k]]
        return at

    def matches(self, codes: np.ndarray, first: np.ndarray, size: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(text, passage, begin, score)`` of the passages in texts that begin at ``first`` and have ``size`` words.

        Each rare word votes for the place where its passage would begin; a
        passage is verified where enough of its rare words agree on a place
        and each key phrase stands in the text within ``slack`` words of its own.
        """
        at = np.flatnonzero(self.first[codes] < self.first[codes + 1])
        low, count = self.first[codes[at]], self.first[codes[at] + 1] - self.first[codes[at]]
        post = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        owner = np.searchsorted(first, np.repeat(at, count), "right") - 1
        begin = np.repeat(at, count) - self.place[post] + len(codes)
        n, p = 2 * len(codes) + 1, len(self.passages)
        key, which = np.unique((owner * n + begin) * p + self.passage[post], return_inverse=True)
        votes, weight = np.bincount(which, minlength=len(key)), np.bincount(which, self.weight[post], len(key))
        passage, begin, owner = key % p, key // p % n - len(codes), key // p // n
        good = votes >= self.needed[passage]
        passage, begin, owner, weight = passage[good], begin[good], owner[good], weight[good]
        kept = np.ones(len(passage), bool)
        for k in np.unique(passage).tolist():
            own = np.flatnonzero(passage == k)
            from_, to = first[owner[own]], first[owner[own]] + size[owner[own]] - 1
            for phrase, offset in self.keys[k]:
                stands, wanted = self.places(codes, phrase), begin[own] + offset
                near = np.searchsorted(stands, np.maximum(wanted - slack, from_)) < np.searchsorted(stands, np.minimum(wanted + slack, to), "right")
                kept[own[~near]] = False
        return owner[kept], passage[kept], begin[kept], weight[kept] / self.total[passage[kept]]


def scan_licences(docs: DataFrame, text: str = "text", passages: tuple[Passage, ...] = PASSAGES, base: dict[str, str] = BASE, rare: int = 8, share: float = 0.5, slack: int = 4) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches)`` of every row of ``docs``.

    ``n_base`` counts the places where the words of a phrase of ``base`` stand
    side by side, ``first_word`` and ``last_word`` are the smallest and largest
    of them in words from 0 (else null), ``base_labels`` their labels.
    ``matches array<struct<label, start, words, score>>`` holds each passage
    that was verified, by start: half (``share``) or more of its ``rare``
    words that weigh most over all documents of the table agree on the place
    where it begins, and each of its key phrases stands within ``slack``
    words of its own place. Its ``score`` is the share of the rare words'
    weight that agreed. ``labels`` joins both kinds, distinct and sorted;
    ``score`` is 1 where a phrase of ``base`` stands, else the best passage's,
    else 0. Weights are counted over the whole table in a pass of their own.

    Null and empty texts have no words, empty labels and score 0. Whole
    texts are read, of any length. Rows that repeat a doc_id, or have none, stand
    for themselves. Other columns are left out, so their names can't clash.
    An empty table gives an empty table.
    """
    wanted = sorted({w for p in passages for x in (p.text, *p.keys) for w in words_in(x.encode())})
    index = RareWords(passages, base, *document_frequency(docs, wanted, text), rare, share)
    long_ = [p.label for p in passages], [len(words_in(p.text.encode())) for p in passages]
    found = T.StructType([T.StructField("label", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("words", T.IntegerType(), False), T.StructField("score", T.DoubleType(), False)])
    kinds = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("matches", T.ArrayType(found, False))]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, k) for n, k in kinds]])
    arrow = pa.list_(pa.field("element", pa.struct([pa.field("label", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("words", pa.int32(), False), pa.field("score", pa.float64(), False)]), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                words, size = _coded(piece.column("text"), index.number)
                n = len(size)
                first = np.cumsum(size) - size + np.arange(n)
                codes = np.zeros(len(words) + n, np.int64)
                codes[np.arange(len(words)) + np.repeat(np.arange(n), size)] = words
                n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                own: list[set[str]] = [set() for _ in range(n)]
                for phrase, label in index.phrases:
                    at = index.places(codes, phrase)
                    owner = np.searchsorted(first, at, "right") - 1
                    n_base += np.bincount(owner, minlength=n)
                    np.minimum.at(low, owner, at - first[owner])
                    np.maximum.at(high, owner, at - first[owner])
                    for o in np.unique(owner).tolist():
                        own[o].add(label)
                owner, passage, begin, score = index.matches(codes, first, size, slack)
                best = np.where(n_base > 0, 1.0, 0.0)
                np.maximum.at(best, owner, score)
                matches: list[list[tuple]] = [[] for _ in range(n)]
                for o, b, p, s in sorted(zip(owner.tolist(), begin.tolist(), passage.tolist(), score.tolist(), strict=True)):
                    matches[o].append((long_[0][p], b - int(first[o]), long_[1][p], s))
                both = [",".join(sorted(x | {m[0] for m in ms})) if x or ms else "" for x, ms in zip(own, matches, strict=True)]
                columns = [pa.array(size), pa.array(n_base), pa.array(low, mask=n_base == 0), pa.array(high, mask=n_base == 0), pa.array([",".join(sorted(x)) for x in own], pa.string()), pa.array(both, pa.string()), pa.array(best)]
                rows = pa.array([[dict(zip(("label", "start", "words", "score"), m, strict=True)) for m in ms] for ms in matches], arrow)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns, rows], schema.names)

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("matches")
