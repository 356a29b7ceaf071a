"""Licence scans with a positional index of rare words.

Licence notices are kept as templates: their words with positions. How rare a
template word is in the corpus (its inverse document frequency) is counted over
all documents. For each document the rarest words of every template are looked
up, so many that a match cannot miss the votes asked for; each occurrence votes, through the postings (template,
position), for an offset: where the template would begin. A match is a stretch
with at least 70 % of the template's words in their order, at offsets that lie
within 8 of each other, so words may be put in or left out. Where enough votes
are that near each other, the longest common sequence of words is taken, up to
8 words to either side of the first vote, and the mandatory phrase must stand in
the stretch word by word. All matches are found; none of less than 70 % is.

Results for odd input: a null or empty text has no words, no labels and score
0; equal texts get equal rows; other columns than doc_id and text are not
looked at; no rows give no rows.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwright.llm.common import map_once

# fixed values: phrases and the labels they give
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: (label, notice, mandatory phrase)
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
     "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
                   "compliance with the license", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     "creative commons attribution noncommercial"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
            "of the software and to permit persons to whom the software is furnished to do so subject to the "
            "following conditions the above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the software the software is provided as is without warranty of any "
            "kind express or implied including but not limited to the warranties of merchantability fitness for a "
            "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for "
            "any claim damages or other liability whether in an action of contract tort or otherwise arising from out "
            "of or in connection with the software or the use or other dealings in the software",
     "to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies "
            "the software is provided as is and the author disclaims all warranties with regard to this software "
            "including all implied warranties of merchantability and fitness in no event shall the author be liable "
            "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss "
            "of use data or profits whether in an action of contract negligence or other tortious action arising out "
            "of or in connection with the use or performance of this software",
     "with or without fee"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
                   "compliance with the license you may obtain a copy of the license at http www apache org licenses "
                   "license 2 0 unless required by applicable law or agreed to in writing software distributed under "
                   "the license is distributed on an as is basis without warranties or conditions of any kind either "
                   "express or implied see the license for the specific language governing permissions and "
                   "limitations under the license",
     "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met redistributions of source code must retain the above copyright "
            "notice this list of conditions and the following disclaimer redistributions in binary form must "
            "reproduce the above copyright notice this list of conditions and the following disclaimer in the "
            "documentation and or other materials provided with the distribution",
     "this list of conditions and the following disclaimer"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation either version 3 of the license or "
            "at your option any later version this program is distributed in the hope that it will be useful but "
            "without any warranty without even the implied warranty of merchantability or fitness for a particular "
            "purpose see the gnu general public license for more details",
     "gnu general public license"),
)

LEAST_VOTES, VOTE_SHARE = 2, 0.2  # votes that are enough for a closer look: a number and a share of the words
LEAST_MATCH = 0.7  # share of a template's words that must stand in order
DRIFT = 8  # how far apart the offsets of a match may lie
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


@dataclass
class Index:
    """Templates as word lists; word -> [(template, position)]; per template, word -> [position]."""

    labels: list[str]
    words: list[list[bytes]]
    phrases: list[list[bytes]]
    postings: dict[bytes, list[tuple[int, int]]]
    places: list[dict[bytes, list[int]]]


def index(templates=TEMPLATES) -> Index:
    made = Index([], [], [], defaultdict(list), [])
    for t, (label, notice, phrase) in enumerate(templates):
        made.labels.append(label)
        made.words.append(words_of(notice))
        made.phrases.append(words_of(phrase))
        made.places.append({})
        for at, word in enumerate(made.words[-1]):
            made.postings[word].append((t, at))
            made.places[t].setdefault(word, []).append(at)
    return made


def _stands(words: list[bytes], phrase: list[bytes], begin: int, end: int) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i in range(max(0, begin), min(len(words), end) - n + 1))


def base_places(words: list[bytes], known: set[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place where a base phrase stands."""
    found = []
    for phrase, label in BASE.items():
        parts = words_of(phrase)
        if all(p in known for p in parts):
            found += [
                (i, label) for i, w in enumerate(words) if w == parts[0] and words[i : i + len(parts)] == parts
            ]
    return sorted(found)


def _needed(notice: list[bytes]) -> int:
    return max(LEAST_VOTES, math.ceil(VOTE_SHARE * len(notice)))


def in_order(words: list[bytes], places: dict[bytes, list[int]], size: int, low: int, high: int) -> tuple[int, int, int]:
    """Most words of a template that stand in order at offsets from ``low`` to ``high``, and where they begin and end.

    ``places`` holds a template's positions by word, ``size`` is its number of words.
    """
    last: list[int] = []  # least template position that ends a sequence of each length
    begins: list[int] = []  # where that sequence begins in the text
    end = low
    for at in range(max(0, low), min(len(words), high + size)):
        for q in reversed(places.get(words[at], ())):  # descending, so that a word is used once
            if low <= at - q <= high:
                i = bisect.bisect_left(last, q)
                begin = begins[i - 1] if i else at
                if i == len(last):
                    last.append(q)
                    begins.append(begin)
                    end = at + 1
                else:
                    last[i], begins[i] = q, begin
    return len(last), begins[-1] if begins else low, end


def scan(words: list[bytes], known: set[bytes], made: Index, idf: dict[bytes, float]) -> list[tuple[str, int, float]]:
    """(label, first word, share in order) of every template that the words hold."""
    anchors, votes = defaultdict(list), defaultdict(list)
    for t, notice in enumerate(made.words):
        held = [q for q, word in enumerate(notice) if word in known]
        # a match may lack this many of the held words
        spare = len(held) - math.ceil(LEAST_MATCH * len(notice))
        if spare < 0 or not all(word in known for word in made.phrases[t]):
            continue
        held.sort(key=lambda q: (-idf.get(notice[q], 0.0), notice[q], q))
        for q in held[: spare + _needed(notice)]:
            anchors[notice[q]].append((t, q))
    if not anchors:
        return []
    for at, word in enumerate(words):
        for t, q in anchors.get(word, ()):
            votes[t].append(at - q)
    found = []
    for t, offsets in votes.items():
        notice, needed, after = made.words[t], _needed(made.words[t]), None
        offsets.sort()
        for i, offset in enumerate(offsets):
            # enough votes from here on, and not a stretch that was found or looked at already
            far = i + needed > len(offsets) or offsets[i + needed - 1] > offset + DRIFT
            if far or (i and offsets[i - 1] == offset) or (after is not None and offset < after):
                continue
            n, begin, end = in_order(words, made.places[t], len(notice), offset - DRIFT, offset + DRIFT)
            if n >= LEAST_MATCH * len(notice) and _stands(words, made.phrases[t], begin - 2, end + 2):
                found.append((made.labels[t], begin, n / len(notice)))
                # the next one of this template lies behind, and lacks 30 % of its words at most
                after = max(offset + DRIFT + 1, end - int((1 - LEAST_MATCH) * len(notice)) - DRIFT)
    return found


def _counter(vocabulary: set[bytes]):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in parts:
            for text in part.column("text").to_pylist():
                counts[b""] += 1  # documents
                counts.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    return batches


def inverse_frequencies(docs: DataFrame, made: Index) -> dict[bytes, float]:
    """Log of documents per document with the word, over all documents; one number per template word."""
    counts = map_once(docs.select("text"), _counter(set(made.postings)), "word string, n long", "licence-words")
    n = {r["word"].encode(): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = n.pop(b"", 0)
    return {w: math.log((total + 1) / (n.get(w, 0) + 1)) for w in made.postings}


_OUT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, notices array<struct<label: string, word: long>>"
)


def _scanner(made: Index, idf: dict[bytes, float]):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                words = words_of(text)
                known = set(words)
                base = base_places(words, known)
                found = scan(words, known, made, idf)
                own = {label for _, label in base}
                rows.append(
                    {
                        "doc_id": doc,
                        "n_words": len(words),
                        "n_base": len(base),
                        "first_word": base[0][0] if base else None,
                        "last_word": base[-1][0] if base else None,
                        "base_labels": ",".join(sorted(own)),
                        "labels": ",".join(sorted(own | {label for label, _, _ in found})),
                        "score": max([share for _, _, share in found], default=0.0),
                        "notices": [{"label": a, "word": b} for a, b, _ in sorted(found)],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return batches


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("notices", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ]
)


def licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Words, base places, labels and notices of every whole text."""
    made = index(templates)
    idf = inverse_frequencies(docs, made)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_once(rows, _scanner(made, idf), _OUT, "licences")
