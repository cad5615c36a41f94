"""License scans by template markup compiled to token automata.

A template is its wording with two kinds of regions. ``[[ ... ]]`` is optional and may hold further regions; ``{{a..b}}`` stands
for any a to b words. Everything else is mandatory and has to match word by word. Texts are lower-cased (A-Z) and cut
into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, so punctuation and line breaks play no part; templates are read in the same way.

Each template becomes an automaton whose transitions are words; it is run from every word that can begin it, in texts that have
the template's anchor, its rarest-looking mandatory word. The longest accepted run counts. Base templates without
regions mark the places that ``n_base`` counts; the rest add labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leasemill.llm import texts

#: The phrases whose places are counted, and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
_MIT_TEXT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this {{1..4}} and associated documentation files [[the {{1..1}}]] "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall {{1..8}} be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_TEXT = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1]] [[a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
    "[[[[3]] [[c]] all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by {{1..12}}]] "
    "[[[[3]] [[4]] [[c]] [[d]] neither the name of {{1..12}} nor the names of {{1..3}} contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission]] "
    "[[[[3]] [[4]] [[c]] [[d]] the {{1..2}} of {{1..12}} may not be used to endorse or promote products derived from this software without specific prior written permission]] "
    "this software is provided by {{1..12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
    "and fitness for a particular purpose are disclaimed in no event shall {{1..12}} be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)


def _spellings(label: str, wording: str) -> tuple[tuple[str, str], ...]:
    """The wording with plain and typographic quotes (which are letters of a word here), and with both spellings of noninfringement."""
    quoted = (wording, wording.replace(" as is ", " “as is” "))
    return tuple((label, w) for w in dict.fromkeys(v for q in quoted for v in (q, q.replace("noninfringement", "non infringement"))))


#: Wordings of licenses and notices, with their regions marked. The labels that end in ``-text`` need the whole license, with its
#: conditions and its disclaimer; the others are those of a notice, a title or a license's opening, whatever follows it.
TEMPLATES = (
    *_spellings("mit-text", _MIT_TEXT),
    *_spellings("bsd-text", _BSD_TEXT),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this {{1..4}} and associated documentation files"),
    ("mit", "[[is]] {{1..1}} under [[the terms of]] the mit license [[see license]]"),
    ("apache-2", "licensed under the apache license version 2 [[0]] [[the license]] [[you may not use this file except in compliance with the license]]"),
    ("cc-by-nc", "[[this work is]] licensed under [[a]] [[creative commons]] cc by nc [[sa]] [[nd]] {{1..1}} 0 [[international [[license]]]]"),
    ("cc-by-nc", "creative commons attribution noncommercial {{0..1}} {{1..1}} 0 [[international]] license"),
    ("gpl-3", "[[[[this {{1..2}} is]] licensed under the]] [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3 "
              "[[of the license]] [[or [[at your option]] any later version]]"),
    ("gpl-2", "gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]] [[or [[at your option]] any later version]]"),
    ("lgpl", "gnu lesser general public license [[as published by the free software foundation]] [[either]] version {{1..2}}"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("spdx", "spdx license identifier {{1..1}}"),
)
#: A wording of this many mandatory words is as likely as not to be a grant by itself.
HALF = 4


@dataclass
class Automaton:
    """States 0 .. n; ``step`` maps (state, word hash) to states, ``any_word`` to states by any word, ``skip`` without a word."""

    label: str
    step: dict[tuple[int, int], list[int]] = field(default_factory=dict)
    any_word: dict[int, list[int]] = field(default_factory=dict)
    skip: dict[int, list[int]] = field(default_factory=dict)
    last: int = 0
    mandatory: list[str] = field(default_factory=list)
    closed: dict[int, frozenset[int]] = field(default_factory=dict)

    def closure(self, state: int) -> frozenset[int]:
        if state not in self.closed:
            seen, todo = {state}, [state]
            while todo:
                for to in self.skip.get(todo.pop(), ()):
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
            self.closed[state] = frozenset(seen)
        return self.closed[state]

    def first(self) -> tuple[set[int], bool]:
        """Hashes of the words that can begin a match, and whether any word can."""
        start = self.closure(0)
        return {h for s, h in self.step if s in start}, any(s in self.any_word for s in start)

    def longest(self, words: list[int], at: int, to: int) -> int:
        """The end of the longest accepted run that starts at word ``at``, or -1."""
        states, end = self.closure(0), -1
        for i in range(at, to):
            after: set[int] = set()
            for s in states:
                for t in self.step.get((s, words[i]), ()):
                    after |= self.closure(t)
                for t in self.any_word.get(s, ()):
                    after |= self.closure(t)
            if not after:
                break
            states = after
            if self.last in states:
                end = i + 1
        return end


def word_hash(word: str) -> int:
    for block in texts.blocks(pa.array([word])):
        return int(texts.word_hashes(block, texts.words(block, texts.ALPHANUMERIC))[0])
    raise ValueError("an empty word")


def compile_template(label: str, wording: str) -> Automaton:
    """The automaton of a template. Regions have to be closed, and some word has to be mandatory."""
    out = Automaton(label)
    here, opened = 0, []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\.\.\d+\}\}|[^\s\[\]{}]+", wording.lower()):
        if token == "[[":
            opened.append(here)
        elif token == "]]":
            out.skip.setdefault(opened.pop(), []).append(here)
        elif token.startswith("{{"):
            least, most = map(int, token[2:-2].split(".."))
            start = here
            for k in range(most):
                out.any_word.setdefault(here, []).append(here + 1)
                here += 1
                if k + 1 < most and k + 1 >= least:
                    out.skip.setdefault(here, []).append(start + most)
            if not least:
                out.skip.setdefault(start, []).append(here)
        else:
            out.step.setdefault((here, word_hash(token)), []).append(here + 1)
            here += 1
            if not opened:
                out.mandatory.append(token)
    if opened or not out.mandatory:
        raise ValueError(f"not a template: {wording}")
    out.last = here
    return out


@dataclass
class Scanner:
    base: list[Automaton]
    others: list[Automaton]

    def __post_init__(self):
        self.all = [(a, True) for a in self.base] + [(a, False) for a in self.others]
        anchors = [word_hash(max(a.mandatory, key=len)) for a, _ in self.all]
        self.anchors = np.array(sorted(set(anchors)), np.uint64)
        self.by_anchor = [(h, a, is_base, *a.first()) for h, (a, is_base) in zip(anchors, self.all)]

    def rows(self, column: pa.Array) -> pa.StructArray:
        out: dict[str, list] = {k: [] for k in FIELDS}
        for block in texts.blocks(column):
            places = texts.words(block, texts.ALPHANUMERIC)
            hashes = texts.word_hashes(block, places)
            near = np.searchsorted(self.anchors, hashes)
            anchor = self.anchors[np.minimum(near, len(self.anchors) - 1)] == hashes
            with_anchor = np.zeros(len(block), bool)
            with_anchor[places.text[anchor]] = True
            for i, n in enumerate(np.diff(places.first).tolist()):
                found = self.text(hashes[places.first[i] : places.first[i + 1]].tolist()) if with_anchor[i] else ([], [])
                self._add(out, n, *found)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), PLACES]
        return pa.StructArray.from_arrays([pa.array(out[k], t) for k, t in zip(FIELDS, kinds)], list(FIELDS))

    def text(self, words: list[int]) -> tuple[list[tuple[int, int, Automaton]], list[tuple[int, int, Automaton]]]:
        """Accepted places (first word, end, automaton) of the base templates and of the others."""
        there: dict[int, list[int]] = {}
        for i, h in enumerate(words):
            there.setdefault(h, []).append(i)
        base, others = [], []
        for anchor, automaton, is_base, first, any_first in self.by_anchor:
            if anchor not in there:
                continue
            starts = range(len(words)) if any_first else sorted(i for h in first for i in there.get(h, ()))
            for at in starts:
                end = automaton.longest(words, at, len(words))
                if end >= 0:
                    (base if is_base else others).append((at, end, automaton))
        return base, others

    def _add(self, out: dict[str, list], n: int, base: list, others: list) -> None:
        starts = [at for at, _, _ in base]
        labels = {a.label for _, _, a in base}
        doubt = 1.0
        for automaton in {id(a): a for _, _, a in base + others}.values():
            doubt *= HALF / (HALF + len(automaton.mandatory))
        out["n_words"].append(n)
        out["n_base"].append(len(base))
        out["first_word"].append(min(starts, default=None))
        out["last_word"].append(max(starts, default=None))
        out["base_labels"].append(",".join(sorted(labels)))
        out["labels"].append(",".join(sorted(labels | {a.label for _, _, a in others})))
        out["score"].append(1 - doubt)
        out["places"].append([{"label": a.label, "first_word": at, "end_word": end} for at, end, a in sorted(base + others, key=lambda p: (p[0], p[1], p[2].label))])


FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
PLACES = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
_TYPE = ("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,"
         "places:array<struct<label:string,first_word:long,end_word:long>>>")


def scan(docs: DataFrame, text: str = "text", templates: tuple = TEMPLATES, base: tuple = BASE) -> Column:
    """One struct per text: n_words; n_base, first_word and last_word of the base places (null without any); base_labels and labels,
    distinct, sorted and joined by commas; score, 0 without a match and nearer 1 the more mandatory words matched; places.

    A null or empty text has no words and no labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        Scanner([compile_template(*t) for t in base], [compile_template(*t) for t in templates]))

    @F.arrow_udf(_TYPE)
    def found(column: pa.Array) -> pa.Array:
        return shared.value.rows(column)

    return found(docs[text])
