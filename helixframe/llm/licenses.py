"""License scan: templates with optional and replaceable regions, compiled into token automata.

Markup: `<<beginOptional>>...<<endOptional>>` may be absent, `<<var;one|two words>>` is one of the
given wordings, `<<var;3-8>>` is any three to eight words. All other wording is mandatory and
must match word for word, in order; white space, case and punctuation do not count.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import NON_WORD, combine, hash_words, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Base phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

_AS_IS = "<<var;as is|“as is”>>"
_ITEM = "<<beginOptional>><<var;1-1>><<endOptional>>"
_HOLDER = "<<var;1-12>>"

#: One-line notices, and the whole texts (grant, conditions, disclaimer) of three licenses: mandatory
#: wording is that of the published licenses, holders' names and list marks are replaceable.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<beginOptional>>version<<endOptional>> 2.0",
    "mit": "<<var;released|licensed|distributed|available|provided>> under <<beginOptional>>the terms of<<endOptional>> "
           "<<var;the|an>> mit license",
    "gpl-notice": "<<var;this work|this program|this software|it>> is <<beginOptional>>free software<<endOptional>> "
                  "<<var;licensed|released|distributed>> under <<beginOptional>>the terms of<<endOptional>> the "
                  "<<beginOptional>>gnu<<endOptional>> <<beginOptional>><<var;lesser|affero>><<endOptional>> general public license "
                  "<<beginOptional>>version <<var;1-1>> <<endOptional>>",
    "cc-by-nc": "<<beginOptional>>licensed under <<endOptional>> <<beginOptional>>a<<endOptional>> cc by nc",
    "creative-commons": "licensed under <<var;a|the>> creative commons <<var;1-6>> license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software "
                      "<<beginOptional>>and associated documentation files<<endOptional>> <<beginOptional>>the <<var;software|“software”>><<endOptional>> "
                      "to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
                      "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
                      "subject to the following conditions the above copyright notice and this permission notice "
                      "<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the "
                      f"software the software is provided {_AS_IS} without warranty of any kind express or implied including but not limited to the "
                      "warranties of merchantability fitness for a particular purpose and <<var;noninfringement|non infringement>> in no event shall "
                      f"{_HOLDER} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
                      "out of or in connection with the software or the use or other dealings in the software",
    "isc-permission": "permission to use copy modify <<var;and|and or>> distribute this software for any purpose with or without fee "
                      "is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
                      f"the software is provided {_AS_IS} and {_HOLDER} <<var;disclaims|disclaim>> all warranties with regard to this software "
                      f"including all implied warranties of merchantability and fitness in no event shall {_HOLDER} be liable for any special direct "
                      "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of "
                      "contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted "
                          f"provided that the following conditions are met {_ITEM} redistributions of source code must retain the above copyright "
                          "notice this list of conditions and the following disclaimer "
                          f"{_ITEM} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
                          "disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>>"
                          f"{_ITEM} neither the <<var;name|names>> of {_HOLDER} nor the names of <<var;its|any|their>> contributors may be used to "
                          "endorse or promote products derived from this software without specific prior written permission<<endOptional>> "
                          f"this software is provided by {_HOLDER} {_AS_IS} and any express or implied warranties including but not limited to the "
                          "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
                          f"{_HOLDER} be liable for any direct indirect incidental special exemplary or consequential damages including but not "
                          "limited to procurement of substitute goods or services loss of use data or profits or business interruption however "
                          "caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
                          "arising in any way out of the use of this software even if advised of the possibility of such damage",
    "copyright-reserved": "copyright <<beginOptional>>c<<endOptional>> <<beginOptional>><<var;1-8>><<endOptional>> all rights reserved",
}
_MARK = re.compile(r"<<(.*?)>>", re.DOTALL)


class Automaton:
    """Token automaton of one template. State 0 is the start, `last` accepts."""

    def __init__(self, template: str):
        self.words: list[dict] = [{}]  # state -> word hash -> next states
        self.any: list[list] = [[]]  # state -> next states on any word
        self.free: list[list] = [[]]  # state -> next states without a word
        stack, at, end = [], 0, 0
        for mark in [*_MARK.finditer(template), None]:
            at = self._run(at, WORD.findall(template[end:mark.start() if mark else len(template)].lower()))
            if mark is None:
                break
            end, name = mark.end(), mark[1]
            if name == "beginOptional":
                stack.append(at)
                at = self._step(at, self.free)
            elif name == "endOptional":
                after = self._step(at, self.free)
                self.free[stack.pop()].append(after)
                at = after
            elif m := re.fullmatch(r"var;(\d+)-(\d+)", name):
                for _ in range(int(m[1])):
                    at = self._step(at, self.any)
                ends = [at]
                for _ in range(int(m[2]) - int(m[1])):
                    at = self._step(at, self.any)
                    ends.append(at)
                at = self._new()
                for e in ends:
                    self.free[e].append(at)
            elif name.startswith("var;"):
                ends = [self._run(self._step(at, self.free), WORD.findall(w.lower())) for w in name[4:].split("|")]
                at = self._new()
                for e in ends:
                    self.free[e].append(at)
            else:
                raise ValueError(f"unknown mark {name}")
        if stack:
            raise ValueError("optional region without end")
        self.last = at
        self.start = self._closed({0})

    def _new(self) -> int:
        self.words.append({})
        self.any.append([])
        self.free.append([])
        return len(self.words) - 1

    def _step(self, at: int, kind: list) -> int:
        new = self._new()
        kind[at].append(new)
        return new

    def _run(self, at: int, words: list[str]) -> int:
        for word, h in zip(words, hash_words(words).tolist()):
            new = self._new()
            self.words[at].setdefault(h, []).append(new)
            at = new
        return at

    def _closed(self, states: set) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for new in self.free[todo.pop()]:
                if new not in seen:
                    seen.add(new)
                    todo.append(new)
        return frozenset(seen)

    def advance(self, states: frozenset, word: int) -> frozenset:
        new = set()
        for s in states:
            new.update(self.words[s].get(word, ()))
            new.update(self.any[s])
        return self._closed(new)

    def openings(self) -> set[tuple[int, int | None]]:
        """First two words of all accepted texts; None where one word is enough or any fits."""
        out = set()
        for s in self.start:
            if self.any[s] or s == self.last:
                raise ValueError("a template begins with mandatory or listed wording")
            for first, targets in self.words[s].items():
                then = self._closed(set(targets))
                if self.last in then or any(self.any[t] for t in then):
                    out.add((first, None))
                out.update((first, second) for t in then for second in self.words[t])
        return out

    def longest(self, hashes: list[int]) -> int:
        """Words of the longest accepted beginning, 0 if there is none."""
        states, best = self.start, 0
        for i, word in enumerate(hashes):
            states = self.advance(states, word)
            if not states:
                break
            if self.last in states:
                best = i + 1
        return best

    def longest_possible(self) -> int:
        return len(self.words)


class Scanner:
    """All places of all templates in a batch of texts."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.automata = [Automaton(t) for t in templates.values()]
        pairs, singles = {}, {}
        for i, automaton in enumerate(self.automata):
            for first, second in automaton.openings():
                if second is None:
                    singles.setdefault(first, set()).add(i)
                else:
                    pairs.setdefault(int(combine(np.array([first, second], np.uint64), 2)[0]), set()).add(i)
        self.pairs, self.singles = pairs, singles
        self.first = np.zeros(1 << 16, dtype=bool)
        firsts = {f for a in self.automata for f, _ in a.openings()}
        self.first[np.array([f & 0xFFFF for f in firsts], dtype=np.int64)] = True

    def places(self, words) -> list[tuple[int, int, int, int]]:
        """(text, template, first word, words) with word numbers counted in each text."""
        hashes, first = words.hashes, words.first
        hits = np.flatnonzero(self.first[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if not hits.size:
            return []
        text_of = np.searchsorted(first, hits, "right") - 1
        stops = first[text_of + 1]
        follow = np.where(hits + 1 < stops, hits + 1, hits)
        pair = combine_pairs(hashes[hits], hashes[follow])
        out = []
        for at, text, stop, here, both, lone in zip(hits.tolist(), text_of.tolist(), stops.tolist(), hashes[hits].tolist(), pair.tolist(), (follow == hits).tolist()):
            found = self.singles.get(here, set())
            if not lone:
                found = found | self.pairs.get(both, set())
            for i in sorted(found):
                automaton = self.automata[i]
                n = automaton.longest(hashes[at:min(stop, at + automaton.longest_possible())].tolist())
                if n:
                    out.append((text, i, at - int(first[text]), n))
        return out


def combine_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    both = np.empty(2 * left.size, dtype=np.uint64)
    both[0::2], both[1::2] = left, right
    return combine(both, 2)[0::2]


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    `base` are plain phrases with labels, `templates` labels with markup; both are compiled the
    same way, and every place counts, overlapping ones too. score is the share of the words that
    stand inside any place. places lists (label, start, words) of both kinds. A null or empty text
    has no words, no places and score 0. Documents do not move: one pass over whole texts.
    """
    base, templates = base or BASE, templates or TEMPLATES
    compiled = {**{f"base:{i}": p for i, p in enumerate(base)}, **templates}
    labels = [*base.values(), *templates]
    plain = len(base)
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("places", pa.list_(place))])

    def run(batches):
        scanner = Scanner(compiled)
        for batch in batches:
            words = words_of(batch.column(1), NON_WORD)
            counts = np.diff(words.first).tolist()
            of: dict[int, list] = {}
            for text, i, start, n in scanner.places(words):
                of.setdefault(text, []).append((start, n, i))
            out = []
            for text, key in enumerate(batch.column(0).to_pylist()):
                found = sorted(of.get(text, []))
                starts = [s for s, _, i in found if i < plain]
                covered = np.zeros(counts[text], dtype=bool) if found else None
                for s, n, _ in found:
                    covered[s:s + n] = True
                out.append((
                    key, counts[text], len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({labels[i] for _, _, i in found if i < plain})), ",".join(sorted({labels[i] for _, _, i in found})),
                    float(covered.mean()) if found else 0.0,
                    [{"label": labels[i], "start": s, "words": n} for s, n, i in found]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
             "score double, places array<struct<label:string,start:bigint,words:bigint>>")
