"""License scans by template markup.

A template is wording with marked regions: what stands between <<beginOptional>>
and <<endOptional>> may be missing, and a <<var;...>> region may be replaced by so
many words of a pattern.  Templates are compiled into automata over words, which
are run from every place where the template can begin; a text carries the notice
where the automaton accepts, that is where all mandatory wording stands exactly.

Beside the templates there are base phrases: labels of plain consecutive words.

Defined results: null and empty texts have no words and no labels; texts of any
length are scanned whole; repeated rows give a row each; empty tables give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_blocks
from .wordarrays import ALNUM_LOWER, words_of

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates by label. Words of a var match its pattern as a whole, `words` gives how many.
TEMPLATES = {
    "notice-apache": "licensed under <<beginOptional>>the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> "
    '<<var;name="version";match="[0-9]+";words="0-2">>',
    "notice-cc": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by "
    '<<beginOptional>>nc<<endOptional>> <<beginOptional>><<var;name="variant";match="sa|nd";words="1-1">><<endOptional>> '
    '<<var;name="version";match="[0-9]+";words="1-2">>',
    "notice-gpl": "licensed under the <<beginOptional>>gnu<<endOptional>> <<beginOptional>>lesser<<endOptional>> general public license "
    '<<beginOptional>>version <<var;name="version";match="[0-9]+";words="1-2">><<endOptional>>',
    "notice-mit": '<<var;name="verb";match="released|licensed|distributed";words="1-1">> under the mit license',
    "notice-reserved": 'copyright <<beginOptional>>c<<endOptional>> <<var;name="years";match="[0-9]+";words="0-2">> '
    '<<var;name="holder";match=".*";words="0-6">> all rights reserved',
}



def _quoted(word: str) -> str:
    """A word that may stand in typographic quotation marks, which words include."""
    return f'<<var;name="quoted";match="[\u201c\u2018]?{word}[\u201d\u2019]?";words="1-1">>'


def _named(name: str, words: str = "1-12") -> str:
    return f'<<var;name="{name}";match=".*";words="{words}">>'


_EXPRESS = '<<var;name="express";match="express(?:ed)?";words="1-1">>'
_NO_WARRANTY = (
    f"this software is provided by {_named('provider')} {_quoted('as')} {_quoted('is')} and any {_EXPRESS} or implied warranties including but not limited "
    "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
    f"{_named('bearer')} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of "
    "substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    '<<var;name="bullet";match="1|a|i";words="0-1">> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer '
    '<<var;name="bullet";match="2|b|ii";words="0-1">> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the '
    "documentation and or other materials provided with the distribution "
)
_GNU = (
    "is free software you can redistribute it and or modify it under the terms of the gnu {0} license as published by the free software foundation "
    '<<beginOptional>>either<<endOptional>> version <<var;name="version";match="[0-9]+";words="1-2">> <<beginOptional>>of the license<<endOptional>> '
    "<<beginOptional>>or at your option any later version<<endOptional>> "
    f"<<beginOptional>>{_named('program', '1-6')} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
    "fitness for a particular purpose see the gnu {0} license for more details<<endOptional>>"
)

# Wordings of common licences and of the headers that they ask for, in words (fixed values), with their optional and replaceable regions.
TEMPLATES |= {
    "text-mit": f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the {_quoted('software')} "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
    "software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
    "<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software "
    f"<<beginOptional>>the software is provided {_quoted('as')} {_quoted('is')} without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    f"fitness for a particular purpose and noninfringement in no event shall {_named('holders')} be liable for any claim damages or other liability whether in an action of "
    "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software<<endOptional>>",
    "text-isc": "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies",
    "text-bsd-2-clause": _BSD + _NO_WARRANTY,
    "text-bsd-3-clause": _BSD
    + f'<<var;name="bullet";match="3|c|iii";words="0-1">> neither the name of {_named("holder")} nor the names of <<var;name="its";match="its|their|other";words="0-1">> contributors may be used to '
    "endorse or promote products derived from this software without specific prior written permission " + _NO_WARRANTY,
    "text-apache-2-header": f'licensed <<beginOptional>>to {_named("owner", "1-30")} <<endOptional>>under the apache license version 2 0 the {_quoted("license")} you may not use this file except in '
    "compliance with the license you may obtain a copy of the license at "
    '<<var;name="address";match="https?|www|apache|org|licenses|license|2|0|txt|html";words="4-9">> '
    f"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an {_quoted('as')} {_quoted('is')} basis without warranties or "
    "conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "text-gpl-header": _GNU.format("<<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public"),
    "text-mpl-2-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
    '<<var;name="address";match="https?|mozilla|org|mpl|2|0";words="4-7">>',
    "text-zlib": f"this software is provided {_quoted('as')} {_quoted('is')} without any express or implied warranty in no event will the authors be held liable for any damages arising from the use "
    "of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject "
    "to the following restrictions",
    "text-boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the "
    f"{_quoted('software')} to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the "
    "software is furnished to do so all subject to the following",
    "text-unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source "
    "code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "text-cc0": "to the extent possible under law "
    + _named("affirmer")
    + " <<var;name=\"verb\";match=\"has|have\";words=\"1-1\">> waived all copyright and related or neighboring rights to",
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")


@dataclass
class Template:
    """A compiled template: automaton states with word, pattern and empty moves."""

    label: str
    word_moves: list[dict[str, int]] = field(default_factory=list)
    pattern_moves: list[list[tuple[re.Pattern, int]]] = field(default_factory=list)
    empty_moves: list[list[int]] = field(default_factory=list)
    final: int = 0

    def state(self) -> int:
        self.word_moves.append({})
        self.pattern_moves.append([])
        self.empty_moves.append([])
        return len(self.word_moves) - 1

    @classmethod
    def compile(cls, label: str, markup: str) -> Template:
        out = cls(label)
        at = out.state()
        opened: list[int] = []
        for i, part in enumerate(_MARK.split(markup)):
            if i % 2 == 0:
                for word in part.lower().split():
                    at, before = out.state(), at
                    out.word_moves[before][word] = at
            elif part == "beginOptional":
                at, before = out.state(), at
                out.empty_moves[before].append(at)
                opened.append(before)
            elif part == "endOptional":
                at, before = out.state(), at
                out.empty_moves[before].append(at)
                out.empty_moves[opened.pop()].append(at)
            else:
                given = dict(re.findall(r'(\w+)="([^"]*)"', part))
                least, most = map(int, given["words"].split("-"))
                pattern = re.compile(given["match"])
                ways = [at] if least == 0 else []
                for k in range(1, most + 1):
                    at, before = out.state(), at
                    out.pattern_moves[before].append((pattern, at))
                    if k >= least:
                        ways.append(at)
                at = out.state()
                for w in ways:
                    out.empty_moves[w].append(at)
        if opened:
            raise ValueError(f"{label}: an optional region is not closed")
        out.final = at
        return out

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty_moves[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def openings(self) -> set[str] | None:
        """Words that a match can begin with; None if a pattern can begin one and has no plain alternatives."""
        out: set[str] = set()
        for s in self.closure({0}):
            out |= set(self.word_moves[s])
            for pattern, _ in self.pattern_moves[s]:
                words = pattern.pattern.split("|")
                if any(re.escape(w) != w for w in words):
                    return None
                out |= set(words)
        return out

    def mandatory(self) -> list[str]:
        """Words that every match holds: those of single moves that all ways to the end take."""
        out = {w for moves in self.word_moves for w in moves}
        for word in sorted(out):
            todo, seen = [0], {0}
            while todo:
                s = todo.pop()
                for t in [t for w, t in self.word_moves[s].items() if w != word] + [t for _, t in self.pattern_moves[s]] + self.empty_moves[s]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            if self.final in seen:
                out.discard(word)
        return sorted(out)

    def match(self, words: Iterator[str]) -> int:
        """Words of the longest match from the first one; 0 if the automaton never accepts."""
        states, best = self.closure({0}), 0
        for n, w in enumerate(words, 1):
            nxt = {self.word_moves[s][w] for s in states if w in self.word_moves[s]}
            nxt |= {t for s in states for p, t in self.pattern_moves[s] if p.fullmatch(w)}
            if not nxt:
                break
            states = self.closure(nxt)
            if self.final in states:
                best = n
        return best

    @staticmethod
    def regex(markup: str) -> str:
        """The same template as a regular expression over ' ' + words joined by ' ' + ' '."""
        out = " "
        for i, part in enumerate(_MARK.split(markup)):
            if i % 2 == 0:
                out += "".join(f"{w} " for w in part.lower().split())
            elif part == "beginOptional":
                out += "(?:"
            elif part == "endOptional":
                out += ")?"
            else:
                given = dict(re.findall(r'(\w+)="([^"]*)"', part))
                inner = given["match"].replace(".*", "[^ ]*")
                out += f"(?:(?:{inner}) ){{{given['words'].replace('-', ',')}}}"
        return out


SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
)


def _hashes(words: list[str]) -> np.ndarray:
    return words_of([" ".join(words)], ALNUM_LOWER).hash


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Per document: places of base phrases, their labels, and all labels with those of the templates.

    score: 1 where a template's whole wording stands, 0.5 for base phrases alone, else 0.
    """
    compiled = [Template.compile(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
    phrases = BASE if base is None else base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = [(label, _hashes(phrase.split())) for phrase, label in phrases.items()]
        starts = [(t, None if (o := t.openings()) is None else _hashes(sorted(o)), _hashes(t.mandatory())) for t in compiled]
        for block, texts in text_blocks(batches, 4_000_000):
            words = words_of(texts, ALNUM_LOWER)
            n = len(texts)
            text_of, n_words = words.text_of(), np.diff(words.first)
            count, lowest, highest = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base_labels: list[set] = [set() for _ in range(n)]
            labels: list[set] = [set() for _ in range(n)]
            for label, hashes in plain:
                at = np.flatnonzero(words.hash == hashes[0])
                for k, h in enumerate(hashes.tolist()[1:], 1):
                    at = at[at + k < len(words)]
                    at = at[words.hash[at + k] == h]
                at = at[at + len(hashes) <= words.first[text_of[at] + 1]]
                t = text_of[at]
                inside = at - words.first[t]
                np.add.at(count, t, 1)
                np.minimum.at(lowest, t, inside)
                np.maximum.at(highest, t, inside)
                for i in np.unique(t).tolist():
                    base_labels[i].add(label)
            present = np.unique(words.hash)
            for template, begin, needed in starts:
                if not np.isin(needed, present, assume_unique=True).all():
                    continue
                at = np.arange(len(words)) if begin is None else np.flatnonzero(np.isin(words.hash, begin))
                for p, t in zip(at.tolist(), text_of[at].tolist(), strict=True):
                    if template.label not in labels[t]:
                        end = int(words.first[t + 1])
                        if template.match(words.word(i).decode("utf-8", "surrogatepass") for i in range(p, end)):
                            labels[t].add(template.label)
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(n_words),
                    pa.array(count),
                    pa.array(lowest, mask=none),
                    pa.array(highest, mask=none),
                    pa.array([",".join(sorted(b)) for b in base_labels], pa.string()),
                    pa.array([",".join(sorted(b | x)) for b, x in zip(base_labels, labels, strict=True)], pa.string()),
                    pa.array([1.0 if x else 0.5 if b else 0.0 for b, x in zip(base_labels, labels, strict=True)]),
                ],
                names=SCHEMA.names,
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)
