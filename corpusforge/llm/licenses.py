"""Operator 3: licence scans over a positional index of rare words.

Each notice (template) is indexed by its rarest words, rarity being the inverse
document frequency over the whole corpus, with their positions in the notice. A
file's words are looked up in the index; a posting says where the notice would
begin, and postings that agree make a candidate. A candidate counts once all the
mandatory phrases of the notice stand at their places in the file.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hash_spans, slices, table, text_buffer

#: Rarest words that index a notice.
RARE = 4
#: Words that may be missing or added between two places of a notice.
SLACK = 3


class Notice(NamedTuple):
    licence: str
    text: str
    phrases: tuple[str, ...]


NOTICES = [
    Notice("Apache-2.0", "licensed under the apache license version 2.0", ("apache license version 2 0",)),
    Notice("MIT", "released under the mit license", ("the mit license",)),
    Notice(
        "MIT-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Notice("GPL-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Notice("GPL-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Notice("LGPL-3.0", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    Notice("LGPL-2.1", "licensed under the gnu lesser general public license version 2.1", ("gnu lesser general public license", "version 2 1")),
    Notice("AGPL-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    Notice("MPL-2.0", "subject to the terms of the mozilla public license version 2.0", ("mozilla public license", "2 0")),
    Notice("EPL-2.0", "made available under the terms of the eclipse public license 2.0", ("eclipse public license", "2 0")),
    Notice("CC-BY-NC-4.0", "licensed under cc by-nc 4.0", ("cc by nc 4 0",)),
    Notice("CC-BY-SA-4.0", "licensed under cc by-sa 4.0", ("cc by sa 4 0",)),
    Notice("CC-BY-ND-4.0", "licensed under cc by-nd 4.0", ("cc by nd 4 0",)),
    Notice("CC-BY-4.0", "licensed under cc by 4.0", ("cc by 4 0",)),
    Notice("CC0-1.0", "dedicated to the public domain under cc0 1.0", ("cc0 1 0",)),
    Notice("BSL-1.0", "distributed under the boost software license version 1.0", ("boost software license", "version 1 0")),
    Notice(
        "BSD-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"),
    ),
    Notice("ISC-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and", "with or without fee is hereby granted")),
    Notice("Unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    Notice("All-rights-reserved", "all rights reserved", ("all rights reserved",)),
    Notice(
        "Apache-2.0-text",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ("you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing", "is distributed on an as is basis without warranties or conditions of any kind"),
    ),
    Notice(
        "MIT-warranty",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied",
        ("this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind"),
    ),
    Notice(
        "BSD-3-text",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("redistributions in binary form must reproduce the above copyright notice", "neither the name of", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ),
    Notice(
        "GPL-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        ("you can redistribute it and or modify it under the terms of the gnu", "as published by the free software foundation", "in the hope that it will be useful but without any warranty"),
    ),
    Notice(
        "MPL-2.0-text",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0",
        ("this source code form is subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file"),
    ),
    Notice(
        "Zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose "
        "the origin of this software must not be misrepresented altered source versions must be plainly marked as such this notice may not be removed or altered from any source distribution",
        ("in no event will the authors be held liable for any damages", "the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such"),
    ),
    Notice(
        "Unlicense-text",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("anyone is free to copy modify publish use compile sell or distribute this software", "for any purpose commercial or non commercial and by any means"),
    ),
    Notice("WTFPL", "do what the fuck you want to public license", ("do what the fuck you want to public license",)),
    Notice("OFL-1.1", "this font software is licensed under the sil open font license version 1.1", ("sil open font license", "version 1 1")),
    Notice("Artistic-2.0", "distributed under the artistic license 2.0", ("the artistic license 2 0",)),
    Notice("EUPL-1.2", "licensed under the european union public licence v 1.2", ("european union public licence", "1 2")),
    Notice("CDDL-1.0", "common development and distribution license version 1.0", ("common development and distribution license", "version 1 0")),
    Notice("CC-BY-NC-SA-4.0", "licensed under cc by-nc-sa 4.0", ("cc by nc sa 4 0",)),
    Notice("CC-BY-NC-ND-4.0", "licensed under cc by-nc-nd 4.0", ("cc by nc nd 4 0",)),
    Notice("CC-BY-prose", "licensed under a creative commons attribution 4.0 international license", ("creative commons attribution", "4 0 international license")),
    Notice("PSF-2.0", "python software foundation license version 2", ("python software foundation license version 2",)),
]

# a word is a run of ASCII letters, digits, and bytes beyond ASCII, in lower case
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def cut(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, rows' offsets, begins, ends, hashes) of the words of a column."""
    raw, rows = text_buffer(col)
    low = _LOWER[raw]
    inside = np.concatenate([[False], _IN_WORD[low], [False]])
    start = inside[1:] & ~inside[:-1]
    stop = inside[:-1] & ~inside[1:]
    edges = rows[1:-1]
    edges = edges[edges < len(raw)]
    within = edges[inside[:-1][edges] & inside[1:][edges]]
    start[within] = True
    stop[within] = True
    begin, end = np.flatnonzero(start[:-1]), np.flatnonzero(stop)
    return raw, rows, begin, end, hash_spans(low, begin, end, 3)


def _hashes(text: str) -> np.ndarray:
    return cut(pa.array([text]))[4]


class _Compiled(NamedTuple):
    vocabulary: np.ndarray  # sorted hashes of the notices' words
    words: list[np.ndarray]
    phrases: list[list[tuple[int, np.ndarray]]]  # (place in the notice, hashes)


def _compile(notices: list[Notice]) -> _Compiled:
    words = [_hashes(n.text) for n in notices]
    phrases = []
    for n, w in zip(notices, words, strict=True):
        at, found = 0, []
        for p in n.phrases:
            h = _hashes(p)
            at = next(i for i in range(at, len(w)) if (w[i : i + len(h)] == h).all() and i + len(h) <= len(w))
            found.append((at, h))
            at += len(h)
        phrases.append(found)
    return _Compiled(np.unique(np.concatenate(words)), words, phrases)


def document_frequencies(docs: DataFrame, compiled: _Compiled) -> tuple[np.ndarray, int]:
    """In how many of all documents each word of the notices stands, and how many there are."""
    vocabulary = compiled.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for b in slices(batches, 0):
            _, rows, begin, _, h = cut(b.column(0))
            k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[k] == h)
            row = np.searchsorted(rows, begin[hit], side="right") - 1
            total[:-1] += np.bincount(np.unique(row * len(vocabulary) + k[hit]) % len(vocabulary), minlength=len(vocabulary))
            total[-1] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    # a few hundred rows: the notices' words
    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(vocabulary) + 1, np.int64)
    for r in got:
        n[r["word"]] = r["n"]
    return n[:-1], int(n[-1])


class Index:
    """Postings (notice, position) of each notice's rarest words."""

    def __init__(self, compiled: _Compiled, frequency: np.ndarray, total: int, rare: int = RARE) -> None:
        self.compiled = compiled
        postings: dict[int, list[tuple[int, int]]] = {}
        self.needed: list[int] = []
        for t, words in enumerate(compiled.words):
            # only words of mandatory phrases are sure to be there
            sure = {int(x) for _, h in compiled.phrases[t] for x in h}
            k = {w: int(np.searchsorted(compiled.vocabulary, np.uint64(w))) for w in sure}
            idf = {w: math.log((total + 1) / (frequency[k[w]] + 1)) for w in sure}
            top = sorted(sure, key=lambda w: (-idf[w], w))[:rare]
            self.needed.append(len(top))
            for at, h in compiled.phrases[t]:
                for i, w in enumerate(h):
                    if int(w) in top:
                        postings.setdefault(int(w), []).append((t, at + i))
        self.words = np.array(sorted(postings), np.uint64)
        self.postings = [postings[int(w)] for w in self.words]

    def scan(self, h: np.ndarray, places: np.ndarray, which: np.ndarray) -> list[tuple[int, int, int]]:
        """(notice, first word, word after the last) of one file's notices.

        places, which: where the file has words of the index, and which.
        """
        votes: dict[int, dict[int, set[int]]] = {}
        for p, w in zip(places.tolist(), which.tolist(), strict=True):
            for t, q in self.postings[w]:
                votes.setdefault(t, {}).setdefault(p - q, set()).add(w)
        found = []
        for t, starts in votes.items():
            # postings whose starts differ by no more than the slack agree
            order = sorted(starts)
            end = -1
            for s in order:
                agree = set().union(*(starts[x] for x in range(s - SLACK, s + SLACK + 1) if x in starts))
                if len(agree) == self.needed[t]:
                    # the votes may all be of a later phrase, that far from the first
                    spans = (self._verify(h, t, s + d) for d in range(-SLACK, SLACK + 1))
                    span = next((x for x in spans if x and x[0] >= end), None)
                    if span:
                        found.append((t, *span))
                        end = span[1]
        return sorted(found, key=lambda x: (x[1], x[0]))

    def _verify(self, h: np.ndarray, t: int, start: int) -> tuple[int, int] | None:
        first = last = None
        for at, phrase in self.compiled.phrases[t]:
            here = start + at if last is None else last + at - gap_from
            spread = [0] if last is None else [x for d in range(SLACK + 1) for x in ((d, -d) if d else (0,))]
            place = next(
                (here + d for d in spread if here + d >= (last or 0) and here + d + len(phrase) <= len(h) and (h[here + d : here + d + len(phrase)] == phrase).all()), None
            )
            if place is None:
                return None
            first = place if first is None else first
            last, gap_from = place + len(phrase), at + len(phrase)
        return first, last


def scan_licences(docs: DataFrame, notices: list[Notice] = NOTICES, rare: int = RARE) -> DataFrame:
    """doc_id, licence, match_no, matched: one row for each notice found.

    match_no counts a file's notices of one licence from 1 in text order;
    matched is the text from the first mandatory phrase to the last. Null and
    empty texts have no notice, repeated rows give repeated matches, other
    columns of docs are ignored.
    """
    compiled = _compile(notices)
    frequency, total = document_frequencies(docs, compiled)
    index = Index(compiled, frequency, total, rare)
    names = [n.licence for n in notices]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            raw, rows, begin, end, h = cut(b.column(1))
            k = np.minimum(np.searchsorted(index.words, h), len(index.words) - 1)
            hit = np.flatnonzero(index.words[k] == h)
            first = np.searchsorted(begin, rows)
            row = np.searchsorted(first, hit, side="right") - 1
            out: list[tuple[int, str, int, str]] = []
            for r in np.unique(row).tolist():
                own = hit[row == r] if len(hit) < 1000 else hit[np.searchsorted(row, r) : np.searchsorted(row, r, side="right")]
                a, z = first[r], first[r + 1]
                number: dict[int, int] = {}
                for t, x, y in index.scan(h[a:z], own - a, k[own]):
                    number[t] = number.get(t, 0) + 1
                    out.append((r, names[t], number[t], raw[begin[a + x] : end[a + y - 1]].tobytes().decode()))
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.string())],
                names=["doc_id", "licence", "match_no", "matched"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, licence string, match_no long, matched string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


_BETWEEN = r"[^a-z0-9\x{80}-\x{10ffff}]+"
_WORD = r"[a-z0-9\x{80}-\x{10ffff}]+"


def _pattern(notice: Notice) -> str:
    """The mandatory phrases in order, with their distance in the notice but for the slack."""
    compiled = _compile([notice])
    regex, last = "", 0
    for (at, h), p in zip(compiled.phrases[0], notice.phrases, strict=True):
        words = _BETWEEN.join(p.split())
        if regex:
            gap = at - last
            regex += f"{_BETWEEN}(?:{_WORD}{_BETWEEN}){{{max(0, gap - SLACK)},{gap + SLACK}}}?"
        regex += words
        last = at + len(h)
    edge = r"[^a-z0-9\x{80}-\x{10ffff}]"
    return f"(?:^|{edge})({regex})(?:$|{edge})"


def _oracle() -> str:
    rows = ", ".join(f"('{n.licence}', '{_pattern(n)}')" for n in NOTICES)
    return f"""
    WITH notices(licence, pattern) AS (VALUES {rows}),
    found AS (
      SELECT doc_id, licence, regexp_extract_all(text, '(?i)' || pattern, 1) AS hits
      FROM documents, notices WHERE regexp_matches(text, '(?i)' || pattern)
    )
    SELECT doc_id, licence, unnest(range(1, len(hits) + 1)) AS match_no, unnest(hits) AS matched FROM found
    """


QUERIES = {"op3_licences": op3_licences}
ORACLES = {"op3_licences": _oracle()}
