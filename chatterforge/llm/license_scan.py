"""License scan by template-markup matching.

A template is a line of words with markup: ``[ ... ]`` may be left out, ``{n}`` stands
for up to n replaceable words.  Each template is compiled into an automaton over
word tokens, with one state between any two words; an optional region adds a way
past it, a replaceable region a counted run of any word.  A text is accepted
where the automaton reaches its end, so that the mandatory wording matched exactly.

Beside the templates, fixed base phrases are counted wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from chatterforge.llm.common import alnum_words, id_text, utf8

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Licence notices and texts, punctuation left out, with markup.
TEMPLATES = {
    "agpl-header": "is free software you can redistribute it and or modify it under the terms of the gnu affero general public "
    "license as published by the free software foundation either version {2} of the license or at your option any later "
    "version",
    "all-rights-reserved": "all rights reserved",
    "apache-2.0-notice": "licensed under the apache license [ version ] 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in "
    "compliance with the license you may obtain a copy of the license at {8} unless required by applicable law or agreed "
    "to in writing software distributed under the license is distributed on an as is basis without warranties or "
    "conditions of any kind either express or implied see the license for the specific language governing permissions "
    "and limitations under the license",
    "bsd-clauses": "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met [ 1 ] redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer [ 2 ] redistributions in binary form must reproduce the above "
    "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
    "provided with the distribution",
    "boost-notice": "distributed under the boost software license version 1 0",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied "
    "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose "
    "are disclaimed in no event shall the copyright {6} be liable for any direct indirect incidental special exemplary or "
    "consequential damages including but not limited to procurement of substitute goods or services loss of use data or "
    "profits or business interruption however caused and on any theory of liability whether in contract strict liability or "
    "tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage",
    "bsd-third-clause": "neither the name of {8} nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission",
    "cc-by-notice": "licensed under [ a ] [ creative commons ] cc by [ nc ] [ sa ] [ nd ] {2} 0",
    "cc-by-text": "this work is licensed under a creative commons attribution [ noncommercial ] [ sharealike ] "
    "[ noderivatives ] {2} international license",
    "cc0-waiver": "to the extent possible under law {12} waived all copyright and related or neighboring rights to",
    "gpl-notice": "licensed under the [ terms of the ] gnu general public license [ version {1} ]",
    "gpl-header": "is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version {1} of the license or at your option any later "
    "version",
    "gpl-warranty": "is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose see the gnu [ lesser ] [ affero ] general public "
    "license for more details",
    "isc-disclaimer": "the software is provided as is and {3} disclaims all warranties with regard to this software including "
    "all implied warranties of merchantability and fitness in no event shall {6} be liable for any special direct indirect "
    "or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of "
    "contract negligence or other tortious action arising out of or in connection with the use or performance of this "
    "software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-header": "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
    "license as published by the free software foundation either version {2} of the license or at your option any later "
    "version",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
    "whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
    "permission notice [ including the next paragraph ] shall be included in all copies or substantial portions of the "
    "software the software is provided as is without warranty of any kind express or implied including but not limited to "
    "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {12} be "
    "liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out "
    "of or in connection with the software or the use or other dealings in the software",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
    "was not distributed with this file you can obtain one at [ http ] [ https ] mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
    "use compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
    "commercial or non commercial and by any means",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held "
    "liable for any damages arising from the use of this software permission is granted to anyone to use this software for "
    "any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
    "restrictions",
}


class TokenAutomaton:
    """The states of one template; state i waits for step i, the last one accepts.

    Steps are a word or None, which takes any word.  ``skips[i]`` are the states that
    can be entered from i without a word.
    """

    def __init__(self, template: str):
        self.steps: list[bytes | None] = []
        self.skips: dict[int, list[int]] = {}
        opened: list[int] = []
        optional = 0
        mandatory: list[bytes] = []
        for token in template.split():
            here = len(self.steps)
            if token == "[":
                opened.append(here)
                optional += 1
            elif token == "]":
                self.skips.setdefault(opened.pop(), []).append(here)
                optional -= 1
            elif token.startswith("{"):
                for k in range(int(token[1:-1])):
                    self.steps.append(None)
                    self.skips.setdefault(here + k, []).append(here + int(token[1:-1]))
            else:
                self.steps.append(token.encode())
                if not optional:
                    mandatory.append(token.encode())
        self.first, self.mandatory, self.accepting = mandatory[0], frozenset(mandatory), len(self.steps)
        self.start = self.closure({0})
        self.moves: dict[tuple[frozenset, bytes | None], frozenset] = {}
        self.alphabet = frozenset(s for s in self.steps if s is not None)

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.skips.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def move(self, states: frozenset, word: bytes) -> frozenset:
        """The states after one more word; kept, so that each is worked out once."""
        key = (states, word if word in self.alphabet else None)
        if key not in self.moves:
            ahead = {s + 1 for s in states if s < self.accepting and self.steps[s] in (None, word)}
            self.moves[key] = self.closure(ahead)
        return self.moves[key]

    def longest(self, words: list[bytes], begin: int) -> int:
        """The end of the longest match that begins here, or -1."""
        states, end = self.start, -1
        for place in range(begin, len(words)):
            states = self.move(states, words[place])
            if not states:
                break
            if self.accepting in states:
                end = place + 1
        return end


@lru_cache(maxsize=4)
def automata(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, TokenAutomaton]]:
    return [(label, TokenAutomaton(template)) for label, template in templates]


def phrase_places(joined: bytes, phrases: dict[str, str]) -> dict[str, list[int]]:
    """label -> word places where its phrases stand; ``joined`` is space-joined with a space at each end."""
    places: dict[str, list[int]] = {}
    for phrase, label in phrases.items():
        needle = f" {phrase} ".encode()
        at, counted, place = joined.find(needle), 0, 0
        while at >= 0:
            # Only the words since the last place are counted, so that many places cost no more than one reading.
            place += joined.count(b" ", counted, at)
            places.setdefault(label, []).append(place)
            counted, at = at, joined.find(needle, at + 1)
    return places


def template_matches(words: list[bytes], compiled: list[tuple[str, TokenAutomaton]]) -> list[tuple[str, int, int]]:
    """(label, start, end) of the leftmost longest matches of each template, which do not overlap."""
    have, found = set(words), []
    for label, automaton in compiled:
        if automaton.mandatory <= have:
            place = 0
            while place < len(words):
                # Every template begins with a mandatory word.
                try:
                    place = words.index(automaton.first, place)
                except ValueError:
                    break
                end = automaton.longest(words, place)
                if end > place:
                    found.append((label, place, end))
                place = max(end, place + 1)
    return found


def _scan(templates: tuple, phrases: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = automata(templates)
        for batch in batches:
            rows = []
            for text in utf8(batch["text"]):
                words = alnum_words(text)
                places = phrase_places(b" " + b" ".join(words) + b" ", phrases)
                starts = [p for found in places.values() for p in found]
                matches = template_matches(words, compiled)
                covered = sum(e - s for _, s, e in matches)
                rows.append(
                    {
                        "n_words": len(words),
                        "n_base": len(starts),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted(places)),
                        "labels": ",".join(sorted({*places, *(label for label, _, _ in matches)})),
                        "score": 1.0 if matches else 0.5 if starts else 0.0,
                        "covered": covered,
                        "matches": [{"label": label, "start": s, "end": e} for label, s, e in matches],
                    }
                )
            table = pa.Table.from_pylist(rows, _FIELDS)
            for part in table.combine_chunks().to_batches() or []:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *part.columns], ["doc_id", *_FIELDS.names])

    return run


_FIELDS = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("covered", pa.int64()),
        ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, covered bigint, matches array<struct<label:string,start:bigint,end:bigint>>"
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """Base phrases, template matches (words, end exclusive), labels and a score per row of ``docs``.

    The score is 1 where a template accepts, 0.5 where only a base phrase stands, else
    0.  Null and empty texts have no words and no labels; very long ones are read whole.  Repeated rows and
    null ids are returned as they are, other columns are not read, and an
    empty table gives an empty result.
    """
    chosen = tuple((TEMPLATES if templates is None else templates).items())
    return id_text(docs, id_col, text_col).mapInArrow(_scan(chosen, PHRASES if phrases is None else phrases), _SCHEMA)
