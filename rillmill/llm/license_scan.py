"""Licence scans by a positional index of rare words.

Licence notices are templates: words in order with mandatory key phrases. The
index posts each word of a key phrase under its template and position. The document frequency of every licence word is
counted over the whole corpus, and a template's anchors are its words of highest IDF. A file's anchor words are
looked up from the rarest on; a hit at position p for a posting at position q
says that the template would start at p - q, and templates whose anchors
agree on the start, give or take ``SLACK`` words between two phrases, are verified on all their key phrases.
An open template has any number of words between its phrases, up to the next place of its first phrase; a heading has
a line to itself. Lines with an SPDX-License-Identifier are read by their ids. What lies within a longer notice of the same licence isn't one more.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmill.llm.shared import sheltered

ANCHORS = 3
SLACK = 12
_WORD = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Template:
    """A licence notice: key phrases in order, each starting at most SLACK words after the one before ends, or anywhere after it if ``open``; ``line``: a line of its own."""

    license: str
    phrases: tuple[str, ...]
    open: bool = False
    line: bool = False

    @cached_property
    def words(self) -> tuple[tuple[str, ...], ...]:
        return tuple(tuple(p.split()) for p in self.phrases)


TEMPLATES = tuple(
    Template(name, tuple(text.split("|")))
    for name, text in (
        ("MIT", "released under the mit license"),
        ("MIT", "licensed under the mit license"),
        ("MIT", "permission is hereby granted free of charge to any person obtaining a copy|the software is provided as is without warranty of any kind"),
        ("Apache-2.0", "licensed under the apache license version 2 0"),
        ("Apache-2.0", "apache license version 2 0 january 2004|terms and conditions for use reproduction and distribution"),
        ("GPL-3.0", "licensed under the gnu general public license version 3"),
        ("GPL-3.0", "gnu general public license|either version 3 of the license or at your option any later version"),
        ("GPL-2.0", "licensed under the gnu general public license version 2"),
        ("GPL-2.0", "gnu general public license|either version 2 of the license or at your option any later version"),
        ("LGPL", "gnu lesser general public license"),
        ("AGPL-3.0", "gnu affero general public license"),
        ("BSD", "licensed under the bsd license"),
        ("BSD", "redistribution and use in source and binary forms with or without modification are permitted"),
        ("ISC", "permission to use copy modify and or distribute this software for any purpose"),
        ("MPL-2.0", "mozilla public license|v 2 0"),
        ("MPL-2.0", "mozilla public license version 2 0"),
        ("EPL", "eclipse public license"),
        ("Unlicense", "this is free and unencumbered software released into the public domain"),
        ("CC0-1.0", "cc0 1 0 universal"),
        ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
        ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4 0"),
        ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
        ("CC-BY-SA-4.0", "creative commons attribution sharealike 4 0"),
        ("CC-BY-4.0", "licensed under cc by 4 0"),
        ("CC-BY-4.0", "creative commons attribution 4 0"),
        ("All-Rights-Reserved", "all rights reserved"),
    )
)

NOTICES = TEMPLATES + tuple(
    Template(name, tuple(text.split("|")), open=kind == "open", line=kind == "line")
    for name, kind, text in (
        ("MIT", "open", "permission is hereby granted free of charge to any person obtaining a copy|the software is provided as is without warranty of any kind"),
        ("MIT", "", "under the mit license"),
        ("MIT", "line", "mit license"),
        ("MIT", "line", "the mit license"),
        ("MIT", "line", "mit license mit"),
        ("MIT", "line", "the mit license mit"),
        ("MIT", "line", "license mit"),
        ("Apache-2.0", "", "under the apache license version 2 0"),
        ("Apache-2.0", "", "under the apache license 2 0"),
        ("Apache-2.0", "line", "apache license 2 0"),
        ("Apache-2.0", "line", "apache license version 2 0"),
        ("Apache-2.0", "line", "license apache 2 0"),
        ("GPL-3.0", "", "under the terms of the gnu general public license version 3"),
        ("GPL-3.0", "", "under the gnu general public license version 3"),
        ("GPL-3.0", "", "under the terms of version 3 of the gnu general public license"),
        ("GPL-3.0", "", "gnu general public license as published by the free software foundation version 3"),
        ("GPL-3.0", "", "gnu general public license as published by the free software foundation either version 3"),
        ("GPL-3.0", "", "gnu general public license version 3 29 june 2007"),
        ("GPL-3.0", "", "gnu general public license v3"),
        ("GPL-3.0", "", "licensed under the gplv3"),
        ("GPL-3.0", "", "licensed under the gpl v3"),
        ("GPL-3.0", "", "licensed under gpl 3 0"),
        ("GPL-2.0", "", "under the terms of the gnu general public license version 2"),
        ("GPL-2.0", "", "under the gnu general public license version 2"),
        ("GPL-2.0", "", "under the terms of version 2 of the gnu general public license"),
        ("GPL-2.0", "", "gnu general public license as published by the free software foundation version 2"),
        ("GPL-2.0", "", "gnu general public license as published by the free software foundation either version 2"),
        ("GPL-2.0", "", "gnu general public license version 2 june 1991"),
        ("GPL-2.0", "", "gnu general public license v2"),
        ("GPL-2.0", "", "licensed under the gplv2"),
        ("GPL-2.0", "", "licensed under the gpl v2"),
        ("GPL-2.0", "", "licensed under gpl 2 0"),
        ("BSD", "line", "bsd license"),
        ("BSD", "line", "bsd 2 clause license"),
        ("BSD", "line", "bsd 3 clause license"),
        ("BSD", "", "under the bsd license"),
        ("BSD", "", "under the bsd 2 clause license"),
        ("BSD", "", "under the bsd 3 clause license"),
        ("ISC", "line", "isc license"),
        ("ISC", "", "under the isc license"),
        ("ISC", "", "permission to use copy modify and distribute this software for any purpose"),
        ("CC-BY-NC-4.0", "", "creative commons attribution noncommercial 4 0 international"),
        ("CC-BY-SA-4.0", "", "creative commons attribution sharealike 4 0 international"),
        ("CC-BY-4.0", "", "creative commons attribution 4 0 international"),
    )
)

_SPDX = re.compile(r"(?<![a-z0-9])spdx-license-identifier:[ \t]*([^\n\r]*)")
SPDX = {
    name.lower() + tail: license_
    for license_, names, tails in (
        ("MIT", "MIT", ("",)),
        ("Apache-2.0", "Apache-2.0", ("",)),
        ("GPL-3.0", "GPL-3.0", ("", "-only", "-or-later")),
        ("GPL-2.0", "GPL-2.0", ("", "-only", "-or-later")),
        ("LGPL", "LGPL-2.0 LGPL-2.1 LGPL-3.0", ("", "-only", "-or-later")),
        ("AGPL-3.0", "AGPL-3.0", ("", "-only", "-or-later")),
        ("BSD", "BSD-2-Clause BSD-3-Clause BSD-4-Clause", ("",)),
        ("ISC", "ISC", ("",)),
        ("MPL-2.0", "MPL-2.0 MPL-2.0-no-copyleft-exception", ("",)),
        ("EPL", "EPL-1.0 EPL-2.0", ("",)),
        ("Unlicense", "Unlicense", ("",)),
        ("CC0-1.0", "CC0-1.0", ("",)),
        ("CC-BY-NC-4.0", "CC-BY-NC-4.0", ("",)),
        ("CC-BY-SA-4.0", "CC-BY-SA-4.0", ("",)),
        ("CC-BY-4.0", "CC-BY-4.0", ("",)),
    )
    for name in names.split()
    for tail in tails
}


def declared(expression: str) -> list[str]:
    """The licences of a lower-case SPDX expression, such as (mit or apache-2.0); ids without a name here are passed over."""
    out, operand = [], True
    tokens = iter(re.findall(r"[a-z0-9][a-z0-9.+:-]*", expression))
    for token in tokens:
        if token == "with":
            next(tokens, None)
        elif token in ("and", "or"):
            operand = True
        elif operand:
            name = SPDX.get(token.rstrip(".+:-"))
            out += [name] if name and name not in out else []
            operand = False
        else:
            break
    return out


def vocabulary(templates: tuple[Template, ...] = NOTICES) -> list[str]:
    return sorted({w for t in templates for p in t.words for w in p} | {"spdx"})


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = NOTICES) -> tuple[dict[str, int], int]:
    """In how many rows each licence word occurs, and the number of rows; every row and the whole of its text count."""
    words = F.array_intersect(F.split(F.lower("text"), "[^a-z0-9]+"), F.array(*map(F.lit, vocabulary(templates))))
    rows = docs.where("text is not null").select(F.explode(F.concat(words, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in rows}
    total = found.pop("", 0)
    return found, total


class Index:
    """word -> [(template, position)] for the anchors of each template; positions count the words of all its phrases."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[str, int], rows: int, anchors: int = ANCHORS, slack: int = SLACK):
        self.templates, self.slack = templates, slack
        self.idf = {w: math.log((rows + 1) / (frequency.get(w, 0) + 1)) for w in vocabulary(templates)}
        self.postings: dict[str, list[tuple[int, int]]] = {}
        self.needed: list[int] = []
        for k, t in enumerate(templates):
            flat = [w for p in t.words for w in p]
            rare = lambda w: (-self.idf[w], w)
            # an open template has the rarest word of each phrase, whose places are then verified one by one
            chosen = sorted({min(p, key=rare) for p in t.words} if t.open else set(flat), key=rare)
            chosen = chosen if t.open else chosen[:anchors]
            self.needed.append(len(chosen))
            for w in chosen:
                self.postings.setdefault(w, []).append((k, flat.index(w)))
        self.rarest_first = sorted(self.postings, key=lambda w: (-self.idf[w], w))
        # each template has its rarest word in the file, so a file with none of these needs no tokens
        rarest = {max(set(w for p in t.words for w in p), key=lambda w: (self.idf[w], [-ord(c) for c in w])) for t in templates}
        self.gate = "(^|[^a-z0-9])(" + "|".join(sorted(map(re.escape, rarest | {"spdx"}))) + ")($|[^a-z0-9])"

    def scan(self, text: str) -> list[tuple[str, int, float]]:
        """(license, word position, score) of each notice in the text; score is the sum of the IDF of its anchors."""
        words = _WORD.findall(text)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.postings:
                places.setdefault(w, []).append(i)
        starts: dict[int, dict[str, list[int]]] = {}
        for w in self.rarest_first:
            for k, q in self.postings[w] if w in places else ():
                starts.setdefault(k, {}).setdefault(w, []).extend(p - q for p in places[w])
        found: dict[tuple[str, int], tuple[int, float]] = {}

        def note(name: str, begin: int, end: int, score: float) -> None:
            e, x = found.get((name, begin), (end, score))
            found[name, begin] = max(e, end), round(max(x, score), 6)

        lines = None
        for k, by_word in starts.items():
            if len(by_word) < self.needed[k]:
                continue
            t = self.templates[k]
            score = sum(self.idf[w] for w in by_word)
            if t.open:
                for begin, end in self.runs(t, words, places):
                    note(t.license, begin, end, score)
                continue
            if t.line and lines is None:
                lines = self.lines(text)
            slack = self.slack * (len(t.words) - 1)
            lists = sorted(by_word.items(), key=lambda x: len(x[1]))
            first = lists[0][1]
            for s in sorted(set(first)):
                if all(any(-slack <= o - s <= slack for o in other) for _, other in lists[1:]):
                    for begin in range(max(0, s - slack), s + slack + 1):
                        end = self.verify(t, words, begin)
                        if end and (not t.line or (begin, end) in lines):
                            note(t.license, begin, end, score)
        if "spdx" in text:
            for m in _SPDX.finditer(text):
                at = len(_WORD.findall(text, 0, m.start()))
                for name in declared(m[1]):
                    note(name, at, at + 3, self.idf["spdx"])
        out, upto = [], {}
        for (name, begin), (end, score) in sorted(found.items(), key=lambda x: x[0]):
            if end > upto.get(name, 0):
                out.append((name, begin, score))
                upto[name] = end
        return out

    @staticmethod
    def lines(text: str) -> set[tuple[int, int]]:
        """First word and end of each line, in words."""
        out, at = set(), 0
        for line in text.splitlines():
            n = len(_WORD.findall(line))
            out.add((at, at + n))
            at += n
        return out

    def runs(self, t: Template, words: list[str], places: dict[str, list[int]]):
        """(begin, end) of each place of the first phrase that the other phrases follow in order before the first phrase comes again."""
        at = []
        for phrase in t.words:
            w = min(phrase, key=lambda w: (-self.idf[w], w))
            k = phrase.index(w)
            at.append([p - k for p in places[w] if p >= k and tuple(words[p - k : p - k + len(phrase)]) == phrase])
        for n, begin in enumerate(at[0]):
            end, limit = begin + len(t.words[0]), at[0][n + 1] if n + 1 < len(at[0]) else len(words)
            for phrase, here in zip(t.words[1:], at[1:]):
                i = bisect_left(here, end)
                if i == len(here) or here[i] >= limit:
                    break
                end = here[i] + len(phrase)
            else:
                yield begin, end

    def verify(self, t: Template, words: list[str], begin: int) -> int:
        """Where the last phrase ends, if all phrases follow one another from there with at most ``slack`` words between; else 0."""
        ends = {begin}
        for n, phrase in enumerate(t.words):
            here = ends if n == 0 else {e + g for e in ends for g in range(self.slack + 1)}
            ends = {e + len(phrase) for e in here if tuple(words[e : e + len(phrase)]) == phrase}
            if not ends:
                return 0
        return max(ends)


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = NOTICES, anchors: int = ANCHORS, slack: int = SLACK) -> DataFrame:
    """(doc_id, license, n_notices, first_word) for each licence with a verified notice in a row of docs.

    Words are lower-case runs of a-z and 0-9, so line breaks, punctuation and
    capitals don't matter; first_word is the place of the first notice's first word. A
    null or empty text has no notices; whole texts are scanned, however long. Of words of equal rarity the first by name is the anchor. Null ids are carried along, rows that repeat are scanned each, an
    empty table gives an empty result. If a file has several licences, each has a row. Columns beside doc_id and
    text are not read, whatever their names.
    """
    docs = sheltered(docs).select(F.col("doc_id").cast("bigint"), "text")
    frequency, rows = document_frequencies(docs, templates)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, frequency, rows, anchors, slack))

    def run(batches):
        import pyarrow.compute as pc

        for b in batches:
            low = pc.utf8_lower(b.column(1))
            may = pc.fill_null(pc.match_substring_regex(low, index.value.gate), False)
            ids, texts = b.column(0).filter(may), low.filter(may).to_pylist()
            row, names, counts, first = [], [], [], []
            for k, text in enumerate(texts):
                found: dict[str, list[int]] = {}
                for name, at, _ in index.value.scan(text):
                    found.setdefault(name, []).append(at)
                for name, at in found.items():
                    row.append(k)
                    names.append(name)
                    counts.append(len(at))
                    first.append(min(at))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int32()), pa.array(first, pa.int32())], ["doc_id", "license", "n_notices", "first_word"]
            )

    return docs.mapInArrow(run, "doc_id bigint, license string, n_notices int, first_word int")
