"""License scans by template markup and token automata.

A template is a line of words with optional and replaceable regions::

    <<optional>>this work is<</optional>> licensed under <<var 0-3>> the mit license

Words outside of regions are mandatory and have to match exactly; an optional region may be missing as a whole; a
replaceable region ``<<var a-b>>`` stands for a to b words of any kind. A template is compiled into an automaton over
words: its states are positions in the template, a set of states is a bit mask, and reading one word takes a few integer
operations. A document accepts a template where the automaton reaches its end; the spans found are the shortest ones
from each start. Texts that lack a template's longest mandatory phrase can't accept it and are passed over.

Base phrases (label by phrase) are found wherever their words stand consecutively, also overlapping.

Defined cases: null and empty texts have no words and no labels; whole texts are read; repeated rows each get the same
answer; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenhand.llm.imatch import _WORD_BYTES

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public licence wordings, as words; owners are replaceable, numbering and some asides optional.
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>>
shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
in no event shall <<var 1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise
arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD_HEAD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met <<optional>>1<</optional>> redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer <<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright
notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_NAMES = """<<optional>>3<</optional>> neither the name of <<var 1-12>> nor the names of <<var 1-3>> contributors may be used to endorse or
promote products derived from this software without specific prior written permission"""
_BSD_TAIL = """this software is provided by <<var 1-12>> as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 1-12>> be liable for any
direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict
liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
possibility of such damage"""
_ISC = """permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby
granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
<<var 1-8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no
event shall <<var 1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from
loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with
the use or performance of this software"""
_APACHE_HEADER = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
you may obtain a copy of the license at <<var 1-1>> www apache org licenses license 2 0 unless required by
applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or
conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under
the license"""
_GPL_HEADER = """free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
software foundation either version {} of the license or at your option any later version <<var 1-4>> is distributed in the hope that it
will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see
the gnu general public license for more details"""
#: Label and template of what the method knows: whole licences, the headers that stand for longer ones, one-line notices.
TEMPLATES = (
    ("mit-text", _MIT),
    ("bsd-2-clause-text", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3-clause-text", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    ("isc-text", _ISC),
    ("apache-2.0-header", _APACHE_HEADER),
    ("gpl-2.0-or-later-header", _GPL_HEADER.format(2)),
    ("gpl-3.0-or-later-header", _GPL_HEADER.format(3)),
    ("apache-2.0", "<<optional>>this <<var 1-2>> is<</optional>> licensed under <<var 0-3>> the apache license <<optional>>version<</optional>> 2 0"),
    ("cc-by-nc-4.0", "<<optional>>this <<var 1-2>> is<</optional>> licensed under <<var 0-4>> cc by nc <<optional>>version<</optional>> 4 0"),
    ("gpl-3.0", "<<optional>>this <<var 1-2>> is<</optional>> licensed under <<var 0-3>> the gnu general public license <<optional>>version<</optional>> 3"),
    ("mit-notice", "<<optional>>this <<var 1-2>> is<</optional>> released under <<var 0-3>> the mit license"),
    ("mit-notice", "<<optional>>this <<var 1-2>> is<</optional>> licensed under <<var 0-3>> the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<var 0-4>> to deal in the software without restriction"),
    ("all-rights-reserved", "<<optional>>copyright <<var 1-8>><</optional>> all rights reserved"),
)


class Automaton(NamedTuple):
    """Bit i of a mask is the state 'the next token is i'; state ``len(tokens)`` accepts."""

    label: str
    template: str
    needs: dict[bytes, int]  # mask of the tokens that are this word
    wild: int  # mask of the tokens that are any word
    skips: tuple[tuple[int, int], ...]  # from a state, without a word, to a later one
    end: int
    key: bytes  # longest mandatory phrase, with blanks around

    def closed(self, states: int) -> int:
        for lo, hi in self.skips:  # in order, so that skips chain
            if states >> lo & 1:
                states |= 1 << hi
        return states

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """``start, end`` (exclusive): for each start the shortest accepted run of words."""
        first = self.closed(1)
        opens = {w for w, mask in self.needs.items() if mask & first} if not self.wild & first else None
        out = []
        for start, word in enumerate(words):
            if opens is not None and word not in opens:
                continue
            states = first
            for at in range(start, len(words)):
                states = self.closed((states & (self.needs.get(words[at], 0) | self.wild)) << 1)
                if not states:
                    break
                if states >> self.end & 1:
                    out.append((start, at + 1))
                    break
        return out


_MARK = re.compile(r"<<(optional|/optional|var (\d+)-(\d+))>>|([^\s<>]+)")


@cache
def automaton(label: str, template: str) -> Automaton:
    needs: dict[bytes, int] = {}
    wild, skips, opened, phrases, at = 0, [], None, [[]], 0
    for match in _MARK.finditer(template):
        mark, low, high, word = match.groups()
        if word:
            needs[word.encode()] = needs.get(word.encode(), 0) | 1 << at
            at += 1
            if opened is None:
                phrases[-1].append(word)
            continue
        phrases.append([])
        if mark == "optional":
            opened = at
        elif mark == "/optional":
            skips.append((opened, at))
            opened = None
        else:
            for i in range(int(high)):
                wild |= 1 << at
                if i >= int(low):
                    skips.append((at, at + 1))
                at += 1
    key = max((" ".join(p) for p in phrases), key=len)
    return Automaton(label, template, needs, wild, tuple(sorted(skips)), at, f" {key} ".encode())


def as_regex(template: str) -> str:
    """The template as a regular expression over a text of words with one blank before each and one at the end."""

    def one(match: re.Match) -> str:
        mark, low, high, word = match.groups()
        if word:
            return f" {word}"
        return {"optional": "(?:", "/optional": ")?"}.get(mark, f"(?: [^ ]+){{{low},{high}}}")

    return re.sub(r"\s*(<<(?:optional|/optional|var \d+-\d+)>>|[^\s<>]+)\s*", lambda m: one(_MARK.match(m[1])), template) + " "


class Finding(NamedTuple):
    n_words: int
    base: list[tuple[int, str]]  # start word and label
    notices: list[tuple[int, int, str]]  # start, end, label


def scan(data: bytes, phrases: dict[str, str] = PHRASES, templates=TEMPLATES) -> Finding:
    words = data.translate(_WORD_BYTES).split()
    line = b" " + b" ".join(words) + b" "
    base, notices = [], []
    for phrase, label in phrases.items():
        needle = f" {phrase} ".encode()
        at, word, seen = line.find(needle), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            base.append((word, label))
            seen, at = at, line.find(needle, at + 1)
    for label, template in templates:
        known = automaton(label, template)
        if known.key in line:
            notices += [(lo, hi, label) for lo, hi in known.spans(words)]
    return Finding(len(words), base, notices)


def find_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words``, ``base`` (array of start and label), ``notices`` (array of start, end, label of the accepted
    template spans) for each row of ``docs``."""
    phrases, templates = dict(phrases), tuple(templates)
    base = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    notice = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py() or b"", phrases, templates) for t in batch.column("data")]
            columns = [
                batch.column("doc_id"), pa.array([f.n_words for f in found], pa.int64()),
                pa.array([[{"start": s, "label": x} for s, x in f.base] for f in found], base),
                pa.array([[{"start": s, "end": e, "label": x} for s, e, x in f.notices] for f in found], notice),
            ]
            yield pa.record_batch(columns, names=["doc_id", "n_words", "base", "notices"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("data"))
    schema = "doc_id bigint, n_words bigint, base array<struct<start:bigint,label:string>>, notices array<struct<start:bigint,end:bigint,label:string>>"
    return rows.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``. The score is 1 for an accepted
    template, 0.5 for a base phrase without one, else 0."""
    labels = lambda *names: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(n) for n in names]))), ",")
    score = F.when(F.size("notices") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0)
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"), labels("base.label").alias("base_labels"), labels("base.label", "notices.label").alias("labels"), score.alias("score"),
    )
