"""License scans: every run of words that holds enough of a licence notice's words, and every base phrase.

Exact set-similarity join of word windows with templates: a template matches where a window of consecutive words, line ends
or not, holds `percent` % of its distinct words or more. The window is as long as the template is at `percent` % of the
window (length filter from above). Words are ordered by how often they occur in all documents, rarest first. A matching
window must hold one of the template's first t - need + 1 words in that order (prefix filter), so only the words around those
are looked at, and only where enough of the template's words stand there (length filter from below); what is left is counted
exactly. Of windows that overlap, the earliest that holds most is returned. Frequent words alone never become candidates.

Scale: two passes over the texts, no shuffle but for a sum of one count per template word and task. The templates are a
small fixed list (or the caller's), so their index is part of the task.

Base phrases are found wherever their words stand consecutively, over line ends too. The score is 1 where a base phrase or a
whole template stands, else the largest share of a matching template, else 0.

Defined results: A-Z is lowered, words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; a null or empty text has no words, empty labels,
score 0 and null first_word and last_word. Rows are returned as often as they occur, a null doc_id
too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm._shared import documents
from hindcast.llm._words import LOWER, PLAIN, Words, slices, texts

#: Base phrases and their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Labels and notices that are searched for.
TEMPLATES = {
    "notice:apache-2.0": "Licensed under the Apache License, Version 2.0",
    "notice:apache-2.0-terms": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "notice:bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "notice:cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "notice:cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "notice:cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "notice:gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "notice:gpl-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "notice:mit": "Released under the MIT License",
    "notice:mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "notice:mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "notice:no-warranty": "the software is provided as is, without warranty of any kind, express or implied",
}
PERCENT = 80


def _words(data: np.ndarray, at: np.ndarray) -> Words:
    return Words(LOWER[data], at, PLAIN)


def _split(text: str) -> tuple[list[str], np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    words = _words(data, np.array([0, len(data)]))
    return [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end, strict=True)], words.hashes()


class Vocabulary:
    """The words of templates and phrases by number; code() gives each word's number or -1."""

    def __init__(self, templates: dict[str, str], base: dict[str, str]):
        pairs = {w: h for text in [*templates.values(), *base] for w, h in zip(*_split(text), strict=True)}
        self.words = sorted(pairs)
        hashes = np.array([pairs[w] for w in self.words], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        number = {w: i for i, w in enumerate(self.words)}
        self.templates = {k: sorted({number[w] for w in _split(t)[0]}) for k, t in templates.items()}
        self.length = {k: len(_split(t)[0]) for k, t in templates.items()}
        self.base = {tuple(number[w] for w in _split(t)[0]): label for t, label in base.items()}

    def code(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


def _count(vocabulary: Vocabulary):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words) + 1, np.int64)
        for batch in batches:
            data, at = texts(batch.column("text"))
            for low, high in slices(at):
                code = vocabulary.code(_words(data[at[low] : at[high]], at[low : high + 1] - at[low]).hashes())
                total += np.bincount(code + 1, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) - 1)), pa.array(total[1:])], ["word", "n"])

    return task


class Index:
    """Templates with their words in global order, rarest first, the first of which a match must hold, and window lengths."""

    def __init__(self, vocabulary: Vocabulary, frequency: dict[int, int], percent: int):
        self.rank = {w: i for i, w in enumerate(sorted(range(len(vocabulary.words)), key=lambda w: (frequency.get(w, 0), w)))}
        self.templates = {k: sorted((self.rank[w] for w in words)) for k, words in vocabulary.templates.items()}
        self.need = {k: -(-percent * len(words) // 100) for k, words in self.templates.items()}
        self.width = {k: -(-100 * n // percent) for k, n in vocabulary.length.items()}
        self.prefix = {k: words[: len(words) - self.need[k] + 1] for k, words in self.templates.items()}

    @staticmethod
    def windows(places: list[int], words: list[int], need: int, width: int) -> list[tuple[int, int, int]]:
        """start, end, distinct words held of the windows that hold enough: one of each run of overlapping ones."""
        found, count, left = [], dict.fromkeys(words, 0), 0
        held = 0
        for right, place in enumerate(places):
            held += count[words[right]] == 0
            count[words[right]] += 1
            # Words that are too far off leave, and first words that stand in the window again.
            while place - places[left] >= width or count[words[left]] > 1:
                count[words[left]] -= 1
                held -= count[words[left]] == 0
                left += 1
            if held < need:
                continue
            if not found or places[left] >= found[-1][1]:
                found.append((places[left], place + 1, held))
            elif held > found[-1][2]:
                found[-1] = (places[left], place + 1, held)
        return found


def _scan(vocabulary: Vocabulary, index: Index):
    number = {r: w for w, r in index.rank.items()}

    def among(ranks: list[int]) -> np.ndarray:
        out = np.zeros(len(number) + 1, bool)
        out[[number[r] + 1 for r in ranks]] = True
        return out

    prefix, member = ({k: among(v) for k, v in x.items()} for x in (index.prefix, index.templates))
    rare = np.any([*prefix.values(), np.zeros(len(number) + 1, bool)], axis=0)
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts(batch.column("text"))
            counts, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for low, high in slices(at):
                part = data[at[low] : at[high]]
                words = _words(part, at[low : high + 1] - at[low])
                counts[low:high] = np.diff(words.first)
                if not len(words):
                    continue
                code, text = vocabulary.code(words.hashes()), words.text_of()
                for phrase, label in vocabulary.base.items():
                    k = len(phrase)
                    here = np.flatnonzero(np.all([code[j : len(code) - k + 1 + j] == w for j, w in enumerate(phrase)], axis=0)) if len(code) >= k else np.zeros(0, int)
                    for i in here[text[here] == text[here + k - 1]].tolist():
                        start = i - int(words.first[text[i]])
                        found[low + text[i]].append({"label": label, "start": start, "end": start + k, "share": None})
                hits = np.flatnonzero(rare[code + 1])
                for k, width in index.width.items():
                    seeds = hits[prefix[k][code[hits] + 1]]
                    low_at = np.maximum(words.first[text[seeds]], seeds - width + 1)
                    high_at = np.minimum(words.first[text[seeds] + 1], seeds + width)
                    # Seeds whose surroundings overlap are one stretch of words.
                    new = np.flatnonzero(np.r_[True, low_at[1:] >= high_at[:-1]]) if len(seeds) else seeds
                    for i, j in zip(new.tolist(), [*new[1:].tolist(), len(seeds)], strict=False):
                        at_k = int(low_at[i]) + np.flatnonzero(member[k][code[low_at[i] : high_at[j - 1]] + 1])
                        if len(at_k) < index.need[k]:
                            continue
                        t = int(text[seeds[i]])
                        start = int(words.first[t])
                        for a, b, held in index.windows(at_k.tolist(), code[at_k].tolist(), index.need[k], width):
                            found[low + t].append({"label": k, "start": a - start, "end": b - start, "share": held / len(index.templates[k])})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(found, kind)], ["doc_id", "n_words", "matches"])

    return task


def license_scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches."""
    docs, vocabulary = documents(df, id_col=id_col, text_col=text_col), Vocabulary(templates, base)
    frequency = docs.mapInArrow(_count(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    index = Index(vocabulary, {r["word"]: r["n"] for r in frequency}, percent)
    rows = docs.mapInArrow(_scan(vocabulary, index), "doc_id long, n_words long, matches array<struct<label:string,start:int,end:int,share:double>>")
    phrases = F.filter("matches", lambda m: m.share.isNull())
    starts = F.transform(phrases, lambda m: m.start.cast("long"))

    def labels(matches):
        return F.array_join(F.sort_array(F.array_distinct(F.transform(matches, lambda m: m.label))), ",")

    score = F.coalesce(F.array_max(F.transform("matches", lambda m: F.coalesce(m.share, F.lit(1.0)))), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size(phrases).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(phrases).alias("base_labels"), labels(F.col("matches")).alias("labels"), score.alias("score"), "matches",
    )
