"""License scans by template-markup matching.

A template is wording with markup: ``[[ ... ]]`` encloses an optional region, ``<<n>>`` stands for
a replaceable region of at most n words, ``{a|b}`` for one of several words. Each template is
compiled into an automaton over words; a place is accepted if the mandatory wording stands there
word for word. Documents are scanned whole, in one pass without a shuffle: automata start only
where their first word (always mandatory) occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerweave.llm import packed, words

SLICE = 8_000_000

#: Consecutive words and their label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Parts of licence texts. Words are what the scan sees: lower case, punctuation separates.
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
    "particular purpose and noninfringement in no event shall <<12>> be liable for any claim damages or other liability whether in an action of contract tort or "
    "otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution"
)
_BSD_NAMES = "[[3]] neither the name of <<12>> nor the names of {its|his|their} contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = (
    "this software is provided by <<12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed in no event shall <<12>> be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory "
    "of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised "
    "of the possibility of such damage"
)

#: Label and template: notices first, then whole licence texts.
TEMPLATES = [
    ("mit", "{released|licensed|distributed|available} under the [[terms of the]] [[expat]] mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license]]"),
    ("gpl-2.0", "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-3.0", "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("lgpl", "gnu {lesser|library} general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "under [[a]] [[the]] {cc|creative commons} {by|attribution} [[<<1>>]] 4 0"),
    ("cc-by-sa", "under [[a]] [[the]] {cc|creative commons} {by|attribution} {sa|sharealike} 4 0"),
    ("cc-by-nc", "under [[a]] [[the]] {cc|creative commons} {by|attribution} {nc|noncommercial} [[{nd|sa}]] 4 0"),
    ("cc0", "cc0 1 0 universal"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
        "[[including the next paragraph]] shall be included in all copies or substantial portions of the software " + _AS_IS,
    ),
    ("bsd-2-clause", f"{_BSD} {_BSD_AS_IS}"),
    ("bsd-3-clause", f"{_BSD} {_BSD_NAMES} {_BSD_AS_IS}"),
    (
        "isc",
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
        "this permission notice appear in all copies the software is provided as is and <<8>> disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall <<8>> be liable for any special direct indirect or consequential damages or any damages whatsoever "
        "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the {author|authors} be held liable for any damages arising from the use of "
        "this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use "
        "this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly "
        "marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in "
        "source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or "
        "authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large "
        "and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        "software under copyright law " + _AS_IS,
    ),
    (
        "apache-2.0",
        "copyright <<12>> licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of "
        "the license at {http|https} www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions "
        "and limitations under the license",
    ),
]

_OTHER = np.ones(256, bool)
_OTHER[0x30:0x3A] = _OTHER[0x61:0x7B] = _OTHER[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ANY = None


class Automaton:
    """Nodes 0 .. n; ``steps[node]`` are (word or _ANY, next), ``skips[node]`` the nodes reached
    without a word. The last node accepts."""

    def __init__(self, template: str):
        self.steps: list[list] = [[]]
        self.skips: list[list[int]] = [[]]
        opened = []
        for token in re.findall(r"\[\[|\]\]|<<\d+>>|\{[^}]*\}|[^\s\[\]{}<>]+", template):
            at = len(self.steps) - 1
            if token == "[[":
                opened.append(at)
            elif token == "]]":
                self.skips[opened.pop()].append(at)
            elif token.startswith("<<"):
                for _ in range(int(token[2:-2])):
                    self._node()
                end = len(self.steps) - 1
                for node in range(at, end):
                    self.steps[node].append((_ANY, node + 1))
                    self.skips[node].append(end)
            elif token.startswith("{"):
                ends = []
                for choice in token[1:-1].split("|"):
                    here = at
                    for word in choice.split():
                        node = self._node()
                        self.steps[here].append((word.encode(), node))
                        here = node
                    ends.append(here)
                end = self._node()
                for node in ends:
                    self.skips[node].append(end)
            else:
                self.steps[at].append((token.encode(), self._node()))
        if opened or self.skips[0] or any(w is _ANY for w, _ in self.steps[0]) or not self.steps[0]:
            raise ValueError(f"a template must begin with a mandatory word: {template}")
        self.end = len(self.steps) - 1

    def _node(self) -> int:
        self.steps.append([])
        self.skips.append([])
        return len(self.steps) - 1

    def closed(self, nodes: Iterable[int]) -> set[int]:
        found, new = set(), list(nodes)
        while new:
            node = new.pop()
            if node not in found:
                found.add(node)
                new += self.skips[node]
        return found

    def first_words(self) -> list[bytes]:
        return [w for w, _ in self.steps[0]]

    def match(self, text, at: int, end: int) -> int:
        """Number of words of the longest accepted run that begins at ``at``; 0 if there is none.
        ``text`` gives the word at a position."""
        nodes, best, i = {0}, 0, at
        while nodes and i < end:
            word = text(i)
            nodes = self.closed(to for n in nodes for w, to in self.steps[n] if w is _ANY or w == word)
            i += 1
            if self.end in nodes:
                best = i - at
        return best


def _scan(phrases: dict[str, str], templates: list[tuple[str, str]]):
    automata = [(label, Automaton(t)) for label, t in templates]
    phrases = [(p.encode().split(), label) for p, label in phrases.items()]

    def found(starts, ends, first, data):
        """(base places: doc, word, size, label; template places likewise)"""
        code, distinct = words.codes(data, starts, ends, _OTHER)
        number = {w: i for i, w in enumerate(distinct)}
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        base, more = [], []
        for phrase, label in phrases:
            n = len(phrase)
            if not all(w in number for w in phrase):
                continue
            hit = np.flatnonzero(code[: max(0, len(code) - n + 1)] == number[phrase[0]])
            for j in range(1, n):
                hit = hit[code[hit + j] == number[phrase[j]]]
            hit = hit[doc[hit] == doc[np.minimum(hit + n - 1, len(doc) - 1)]] if len(hit) else hit
            base += [(int(doc[i]), int(i), n, label) for i in hit]
        text = lambda i: distinct[code[i]]
        for label, automaton in automata:
            begin = [number[w] for w in automaton.first_words() if w in number]
            for i in np.flatnonzero(np.isin(code, begin)).tolist() if begin else []:
                d = int(doc[i])
                if n := automaton.match(text, i, int(first[d + 1])):
                    more.append((d, i, n, label))
        return base, more

    def run(batches):
        for batch in batches:
            for part in packed.slices(batch, "_text", SLICE):
                data, at = packed.texts(part.column("_text"))
                data = _LOWER[data]
                starts, ends, first = words.spans(data, at, _OTHER)
                base, more = found(starts, ends, first, data)
                rows = len(at) - 1
                size = np.diff(first)
                places = [[] for _ in range(rows)]
                labels = [set() for _ in range(rows)]
                spans = [[] for _ in range(rows)]
                for d, i, n, label in base:
                    places[d].append((i - int(first[d]), label))
                for d, i, n, label in base + more:
                    labels[d].add(label)
                    spans[d].append((i - int(first[d]), n, label))
                covered = [len({w for i, n, _ in s for w in range(i, i + n)}) for s in spans]
                yield pa.record_batch(
                    [
                        part.column("_id"),
                        pa.array(size),
                        pa.array([len(p) for p in places], pa.int64()),
                        pa.array([min(p)[0] if p else None for p in places], pa.int64()),
                        pa.array([max(p)[0] if p else None for p in places], pa.int64()),
                        pa.array([",".join(sorted({x for _, x in p})) for p in places], pa.string()),
                        pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                        pa.array([c / n if n else 0.0 for c, n in zip(covered, size.tolist(), strict=True)], pa.float64()),
                        pa.array([[{"word": a, "words": n, "label": x} for a, n, x in sorted(s)] for s in spans], pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))),
                    ],
                    ["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
                )

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels,
    score and matches (word, words, label of each place).

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. score is
    the share of the words that lie in a place. Null or empty text: no words, no places, empty
    labels, score 0. Repeated rows and null ids are each scanned; no row is dropped. Other columns
    are ignored. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    run = _scan(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    return packed.map_batches(
        rows,
        run,
        f"_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "matches array<struct<word: long, words: long, label: string>>",
    ).withColumnRenamed("_id", id_col)
