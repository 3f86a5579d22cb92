"""License scans by patience alignment of documents with notice templates.

A match may miss ``m = floor((1 - least) * words)`` of a template's words at most, so of
any ``m + 1`` places of a template a match holds one. A template is aligned with all
stretches of a text around such places, those of the words that are rarest in the text:
the choice loses no match. Words
unique in both are anchors, the longest increasing subsequence of their places is kept,
and the gaps between anchors are aligned the same way (equal words at a gap's ends match
first). Coverage is the share of the template's words that are matched. A document has
the license of the best coverage (then the longer template, then the name), and
``licenses`` lists all at or above ``least``.

Words are compared in lower case without punctuation at their ends. Rows are scanned
apart from each other, whole, without a shuffle; the work on a template is bounded by the
occurrences of its words.

Defined results: a NULL or empty text has no license (``license`` NULL, coverage 0);
repeated rows give repeated results; other columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumlake.llm.common import byte_texts

# Public license notices, short and long forms.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in "
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "all-rights-reserved": "All rights reserved.",
}
LEAST = 0.8
_ENDS = b".,;:!?()[]{}\"'`*#$%&|"

FOUND = "doc_id bigint, license string, coverage double, matched_words bigint, first_word bigint, last_word bigint, licenses array<string>, n_words bigint"


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(_ENDS) for w in text.lower().split()]


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails, ends, back = [], [], []
    for i, place in enumerate(places):
        k = bisect_left(tails, place)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(place)
            ends.append(i)
        else:
            tails[k], ends[k] = place, i
    chain, at = [], ends[-1] if ends else -1
    while at >= 0:
        chain.append(at)
        at = back[at]
    return chain[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Matched (text place, template place), increasing in both."""
    matched, open_ = [], [(0, len(text), 0, len(template))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        at = {text[i]: i for i in range(a, b)}
        anchors = [(at[template[j]], j) for j in range(c, d) if there[template[j]] == 1 and here.get(template[j]) == 1]
        chain = [anchors[k] for k in increasing([i for i, _ in anchors])]
        if not chain:
            continue
        matched += chain
        gaps = [(a - 1, c - 1), *chain, (b, d)]
        open_ += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(gaps, gaps[1:])]
    return sorted(matched)


def best_match(places: dict[bytes, list[int]], text: list[bytes], template: list[bytes], least: float = LEAST) -> list[tuple[int, int]]:
    """The longest alignment among the stretches that can hold a match."""
    at = defaultdict(list)
    for j, word in enumerate(template):
        at[word].append(j)
    may_miss = len(template) - math.ceil(least * len(template))
    rare = sorted(at, key=lambda w: (len(places.get(w, ())), at[w][0]))
    slack, best, tried, seeded = max(2, len(template) // 4), [], set(), 0
    for word in rare:
        if seeded > may_miss:
            break
        seeded += len(at[word])
        for place in places.get(word, ()):
            for j in at[word]:
                lo, hi = max(0, place - j - slack), min(len(text), place - j + len(template) + slack)
                if (lo, hi) in tried:
                    continue
                tried.add((lo, hi))
                # Words that the stretch does not hold cannot be matched.
                missed, most = 0, min(may_miss, len(template) - len(best) - 1)
                for w in rare:
                    there = places.get(w, ())
                    missed += max(0, len(at[w]) - bisect_left(there, hi) + bisect_left(there, lo))
                    if missed > most:
                        break
                else:
                    found = [(lo + i, k) for i, k in align(text[lo:hi], template)]
                    if len(found) > len(best):
                        best = found
                    if len(best) == len(template):
                        return best
    return best


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its license, how much of the notice is there and where (word numbers from 0)."""
    notices = {name: words_of(body.encode()) for name, body in templates.items()}
    needed = set().union(*notices.values()) if notices else set()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64())]
        + [("first_word", pa.int64()), ("last_word", pa.int64()), ("licenses", pa.list_(pa.string())), ("n_words", pa.int64())]
    )

    def one(body: bytes) -> tuple:
        words = words_of(body)
        places = defaultdict(list)
        for i, word in enumerate(words):
            if word in needed:
                places[word].append(i)
        found = []
        for name, notice in notices.items():
            there = sum(w in places for w in notice)
            if there < least * len(notice):
                continue
            match = best_match(places, words, notice, least)
            if len(match) >= least * len(notice):
                found.append((-len(match) / len(notice), -len(notice), name, match))
        if not found:
            return None, 0.0, 0, None, None, [], len(words)
        share, _, name, match = min(found)
        return name, -share, len(match), match[0][0], match[-1][0], sorted(f[2] for f in found), len(words)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(body) for body in byte_texts(batch.column(1))]
            columns = list(zip(*rows)) if rows else [[]] * 7
            arrays = [pa.array(list(column), field.type) for column, field in zip(columns, list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, FOUND)
