"""License scans by diagonal voting.

Every rolling window of K words of a text meets the template positions of equal hash in a Spark join. A meeting votes for the
diagonal (text position less template position); votes are summed by diagonal, neighbouring diagonals, between which a few
words were added or left out, are merged to spans, and each span is compared with its template word by word. Of spans that
overlap, the one with most words of its template counts.
Words that no template has are alike to all this, so texts travel as the numbers of their template words, and only
where a window could meet a template at all.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from covermap.llm.common import alphanumeric_words as words_of, kept, slices

#: Words of a window.
K = 4
#: Diagonals that lie at most so far apart belong to one span; a span reaches so many words beyond its diagonals.
SLACK = 4
#: A span is a template's if they have, in order, at least this share of the template's words in common.
LEAST_SHARE = 0.8
#: The score of a text with base phrases alone.
BASE_SCORE = 0.5

# The phrases whose places are counted, and their labels.
BASE_PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Wordings of published licenses and notices, by the identifier in common use.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
                   "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                     "following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
            "to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows of ``size`` words that hold template words (numbers from 1 on) only."""
    count = len(numbers) - size + 1
    if count < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    hashes, whole = np.zeros(count, dtype=np.uint64), np.ones(count, dtype=bool)
    for place in range(size):
        part = numbers[place : place + count]
        whole &= part > 0
        hashes = hashes * _FACTOR + part.astype(np.uint64)
    at = np.flatnonzero(whole)
    return at, hashes[at].view(np.int64)


def common_words(a: Sequence[int], b: Sequence[int]) -> int:
    """The length of the longest common subsequence; numbers below 1 equal nothing. One addition of long integers per word of ``a``."""
    places: dict[int, int] = {}
    for place, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << place
    every = (1 << len(b)) - 1
    row = every
    for word in a:
        if word > 0 and (match := places.get(word)):
            both = row & match
            row = ((row + both) | (row - both)) & every
    return len(b) - row.bit_count()


class _Wordings:
    """Templates and base phrases as numbers of their words."""

    def __init__(self, templates: Sequence[tuple[str, str]], k: int):
        self.k, self.ids = k, {}
        number = lambda text: [self.ids.setdefault(word, len(self.ids) + 1) for word in words_of(text.encode())]
        self.labels = [label for label, _ in templates]
        self.templates = [number(text) for _, text in templates]
        self.base = [(label, number(text)) for label, text in BASE_PHRASES]

    def positions(self) -> pa.Table:
        """(hash, template, at): the windows of all templates. A template of fewer than K words has none."""
        rows = [(value, template, at) for template, words in enumerate(self.templates)
                for at, value in zip(*(part.tolist() for part in window_hashes(np.array(words, dtype=np.int32), self.k)))]
        return pa.table({"hash": pa.array([row[0] for row in rows], pa.int64()), "template": pa.array([row[1] for row in rows], pa.int32()),
                         "at": pa.array([row[2] for row in rows], pa.int32())})

    def base_places(self, numbers: np.ndarray) -> list[tuple[str, np.ndarray]]:
        found = []
        for label, phrase in self.base:
            count = max(len(numbers) - len(phrase) + 1, 0)
            equal = np.ones(count, dtype=bool)
            for place, word in enumerate(phrase):
                equal &= numbers[place : place + count] == word
            found.append((label, np.flatnonzero(equal)))
        return found


_READ = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, numbers binary, at array<int>, hashes array<bigint>"


def _read(documents: DataFrame, shared) -> DataFrame:
    """A row per text: its words, its base places, and its windows; ``numbers`` only where there are windows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordings: _Wordings = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in slices(batch.column(1)):
                rows = []
                for doc_id, text in zip(ids[start:], texts):
                    words = words_of(text)
                    numbers = np.fromiter(map(wordings.ids.get, words, (0,) * len(words)), dtype=np.int32, count=len(words))
                    if not numbers.any():
                        rows.append((doc_id, len(words), 0, None, None, [], None, [], []))
                        continue
                    places = wordings.base_places(numbers)
                    found = np.concatenate([at for _, at in places])
                    labels = sorted({label for label, at in places if len(at)})
                    at, hashes = window_hashes(numbers, wordings.k)
                    rows.append((doc_id, len(words), len(found), int(found.min()) if len(found) else None, int(found.max()) if len(found) else None, labels,
                                 numbers.astype("<i4").tobytes() if len(at) else None, at.tolist(), hashes.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(map(list, zip(*rows)), kinds)], names=names)

    names = [part.split()[0] for part in _READ.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.list_(pa.string()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(read, _READ)
    # Written with the row's number, so that every later reading and every replaced task sees the same one.
    return kept(texts.withColumn("row", F.monotonically_increasing_id()))


def _spans(texts: DataFrame, wordings: _Wordings) -> DataFrame:
    """(row, template, low, high): where the diagonals of a template's spans lie in a text."""
    positions = texts.sparkSession.createDataFrame(wordings.positions()).withColumnRenamed("at", "template_at")
    windows = texts.where(F.size("at") > 0).select("row", F.explode(F.arrays_zip("at", "hashes")).alias("window"))
    votes = windows.select("row", F.col("window.at").alias("at"), F.col("window.hashes").alias("hash")).join(positions, "hash")
    diagonals = votes.groupBy("row", "template", (F.col("at") - F.col("template_at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    parted = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > SLACK, F.lit(True))
    numbered = diagonals.withColumn("parted", parted.cast("int")).withColumn("span", F.sum("parted").over(along))
    return numbered.groupBy("row", "template", "span").agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))


def _verified(texts: DataFrame, spans: DataFrame, shared, least: float) -> DataFrame:
    """(row, found): the spans that have enough of their template, as (label, start, end, votes, share)."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int64()), ("share", pa.float64())]))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordings: _Wordings = shared.value
        for batch in batches:
            result = []
            for raw, own in zip(batch.column(1), batch.column(2)):
                numbers, found = np.frombuffer(raw.as_py(), dtype="<i4"), []
                for span in own.as_py():
                    words = wordings.templates[span["template"]]
                    start, end = max(span["low"] - SLACK, 0), min(span["high"] + len(words) + SLACK, len(numbers))
                    common = common_words(numbers[start:end].tolist(), words)
                    if common >= least * len(words):
                        start, end = max(span["low"], 0), min(span["high"] + len(words), len(numbers))
                        found.append((-common, len(words), wordings.labels[span["template"]], start, end, span["votes"]))
                result.append([{"label": label, "start": start, "end": end, "votes": votes, "share": -common / size}
                               for common, size, label, start, end, votes in _apart(sorted(found))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(result, kind)], names=["row", "found"])

    listed = spans.groupBy("row").agg(F.collect_list(F.struct("template", "low", "high", "votes")).alias("spans"))
    meant = texts.where(F.size("at") > 0).select("row", "numbers").join(listed, "row").select("row", "numbers", "spans")
    return meant.mapInArrow(compared, "row bigint, found array<struct<label: string, start: bigint, end: bigint, votes: bigint, share: double>>")


def _apart(spans: list[tuple]) -> Iterator[tuple]:
    """The spans, best first, that overlap no better one: of licenses that differ by a word, the closest is meant."""
    starts, ends = [], []
    for span in spans:
        start, end = span[3:5]
        place = bisect_right(starts, start)
        if (place == 0 or ends[place - 1] <= start) and (place == len(starts) or end <= starts[place]):
            starts.insert(place, start)
            ends.insert(place, end)
            yield span


def _searched(documents: DataFrame, templates: Sequence[tuple[str, str]], k: int, least: float) -> tuple[DataFrame, DataFrame]:
    wordings = _Wordings(templates, k)
    shared = documents.sparkSession.sparkContext.broadcast(wordings)
    texts = _read(documents, shared)
    return texts, kept(_verified(texts, _spans(texts, wordings), shared, least))


def license_spans(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = K, least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, label, start, end, votes, share): the verified spans, in words from ``start`` up to ``end``."""
    texts, found = _searched(documents, templates, k, least)
    return texts.select("row", "doc_id").join(found, "row").select("doc_id", F.explode("found").alias("one")).select("doc_id", "one.*")


def scan_licenses(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, k: int = K, least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of ``documents``.

    n_base counts the places of all base phrases; first_word and last_word are the smallest and largest of their first words,
    null without any. labels holds base_labels and those of templates (label, text) of which a span has at least the ``least``
    share, each once, sorted and joined by commas. score is the largest such share, BASE_SCORE for base phrases alone, else 0.
    Templates of fewer than ``k`` words are never found. Null and empty texts have no words, no labels and
    score 0; null ids stay, repeated rows are reported each, other columns are not read.
    """
    texts, found = _searched(documents, templates, k, least)
    found = found.select("row", F.col("found.label").alias("more"), F.array_max("found.share").alias("share"))
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    based = F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))
    return texts.drop("numbers", "at", "hashes").join(found, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.greatest(F.coalesce("share", F.lit(0.0)), based).alias("score"))
