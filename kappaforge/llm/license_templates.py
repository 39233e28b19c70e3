"""Licence scans by template-markup matching.

A template is the wording of a licence or notice with marked regions:

    [[ ... ]]              optional words
    {{name;1-6}}           a replaceable region of 1 to 6 words
    {{name;1-2;[0-9]+}}    the same, each word matching a pattern

It is compiled into an automaton over words. A template accepts a place of a
text where all mandatory wording stands exactly, with optional and replaceable
regions as marked. Words are digits, a-z after lower-casing, and non-ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaforge.llm.words import ALNUM_LOWER, LOWER, Hash, U, blocks, spans, window_starts

#: base phrases and their labels (fixed values)
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_AS_IS = "is provided as is"
#: label -> templates
TEMPLATES = {
    "mit": (
        "[[this work is]] {{verb;1-1;released|licensed|distributed|available|published}} under the mit license",
        "[[this work is]] {{verb;1-1;released|licensed|distributed|available|published}} under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including without limitation the rights to use "
        "copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software " + "the software " + _AS_IS + " without warranty of any kind",
    ),
    "apache-2": (
        "apache license version 2 0 january 2004",
        "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "agpl-3": (
        "under the [[terms of the]] gnu affero general public license [[as published by the free software foundation]] [[either]] version 3",
        "gnu affero general public license version 3 19 november 2007",
    ),
    "boost": ("distributed under the boost software license version 1 0", "boost software license version 1 0 august 17th 2003"),
    "cc-by": (
        "creative commons attribution {{version;1-2;[0-9]+}} [[international|unported|generic]] license", "licensed under cc by {{version;1-2;[0-9]+}}", "licensed under a cc by {{version;1-2;[0-9]+}}",
    ),
    "cc-by-sa": (
        "creative commons attribution sharealike {{version;1-2;[0-9]+}} [[international|unported|generic]] license", "creative commons attribution share alike {{version;1-2;[0-9]+}} [[international|unported|generic]] license", "licensed under [[a]] cc by sa [[{{version;1-2;[0-9]+}}]]",
    ),
    "cc0": (
        "cc0 1 0 universal", "to the extent possible under law {{holder;1-10}} {{verb;1-1;has|have}} waived all copyright and related or neighboring rights to",
    ),
    "epl": ("under the terms of the eclipse public license [[v|version]] {{version;1-2;[0-9]+}}", "eclipse public license [[v|version]] {{version;1-2;[0-9]+}}"),
    "lgpl": (
        "under the [[terms of the]] gnu {{kind;1-1;lesser|library}} general public license [[as published by the free software foundation]] [[either]] version {{version;1-2;[0-9]+}}",
        "gnu lesser general public license version {{version;1-2;[0-9]+}} {{date;1-3}}",
    ),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license version 2 0"),
    "wtfpl": ("do what the fuck you want to public license",),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",),
    "cc-by-nc": (
        "licensed under [[a]] cc by nc [[{{version;1-2;[0-9]+}}]]",
        "creative commons attribution noncommercial {{version;1-2;[0-9]+}} [[international|unported]] license",
    ),
    "gpl-2": ("under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2", "gnu general public license version 2 june 1991"),
    "gpl-3": ("under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3", "gnu general public license version 3 29 june 2007"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bsd-3": (
        "neither the name of {{holder;1-12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "all-rights-reserved": ("[[copyright [[c]] {{years;1-2;[0-9]+}} {{holder;1-8}}]] all rights reserved",),
}

ANCHOR = 3
_WORD, _RUN = Hash(61), Hash(62)
_BITS = 20
_TOKEN = re.compile(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+")


@dataclass
class Automaton:
    """Word automaton: ``steps[state]`` has (test, next state), test a word or a pattern or None for no word."""

    label: str
    steps: list[list[tuple[object, int]]]
    accept: int
    mandatory: int
    anchor: tuple[str, ...]
    reach: int  # most words before the anchor

    def closure(self, states: dict[int, int]) -> dict[int, int]:
        """``states`` (with mandatory words consumed) and what no-word steps reach."""
        todo = list(states)
        while todo:
            s = todo.pop()
            for test, to in self.steps[s]:
                if test is None and states.get(to, -1) < states[s]:
                    states[to] = states[s]
                    todo.append(to)
        return states

    def run(self, words: list[str], start: int) -> tuple[int, int]:
        """(end of the longest accepted place that begins at ``start`` or -1, most mandatory words matched)."""
        states, end, best = self.closure({0: 0}), -1, 0
        at = start
        while states:
            if self.accept in states:
                end = at
            best = max(best, max(states.values()))
            if at >= len(words):
                break
            word, after = words[at], {}
            for s, done in states.items():
                for test, to in self.steps[s]:
                    if test is not None and (word == test if isinstance(test, str) else test.fullmatch(word)):
                        gain = done + isinstance(test, str)
                        if after.get(to, -1) < gain:
                            after[to] = gain
            states = self.closure(after)
            at += 1
        return end, best


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of one template; words inside optional regions may be alternatives a|b."""
    steps: list[list[tuple[object, int]]] = [[]]
    state, opened, mandatory = 0, [], 0
    run: list[str] = []
    best: tuple[int, tuple[str, ...]] = (0, ())
    most = 0  # most words so far

    def new() -> int:
        steps.append([])
        return len(steps) - 1

    for token in _TOKEN.findall(markup):
        if token == "[[":
            opened.append(state)
            run = []
        elif token == "]]":
            steps[opened.pop()].append((None, state))
            run = []
        elif token.startswith("{{"):
            _, size, *pattern = token[2:-2].split(";")
            low, high = map(int, size.split("-"))
            test = re.compile(pattern[0] if pattern else ".+")
            ends = [state] if low == 0 else []
            for k in range(1, high + 1):
                to = new()
                steps[state].append((test, to))
                state = to
                if k >= low:
                    ends.append(state)
            for s in ends[:-1]:
                steps[s].append((None, state))
            run, most = [], most + high
        else:
            to = new()
            for word in token.split("|"):
                steps[state].append((word, to))
            state, most = to, most + 1
            if opened or "|" in token:
                run = []
            else:
                mandatory += 1
                run = [*run, token][-ANCHOR:]
                if len(run) == ANCHOR and not best[1]:
                    best = (most, tuple(run))
    if not best[1]:
        raise ValueError(f"a template needs {ANCHOR} mandatory words in a row: {markup}")
    return Automaton(label, steps, state, mandatory, best[1], best[0] - ANCHOR)


class Scanner:
    """All phrases and templates, compiled once per worker."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.automata = [compile_template(label, t) for label, ts in templates.items() for t in ts]
        self.phrases = [(tuple(p.split()), label) for p, label in PHRASES]
        by_size: dict[int, dict[int, list[tuple[tuple[str, ...], object]]]] = {}
        for words, what in [*self.phrases, *((a.anchor, a) for a in self.automata)]:
            by_size.setdefault(len(words), {}).setdefault(self._hash(words), []).append((words, what))
        self.by_size = by_size
        self.filters = {}
        for size, table in by_size.items():
            flags = np.zeros(1 << _BITS, bool)
            flags[[h & ((1 << _BITS) - 1) for h in table]] = True
            self.filters[size] = flags

    @staticmethod
    def _hash(words: tuple[str, ...]) -> int:
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw])
        h = _WORD.words(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
        return int(_RUN.slices(h, np.array([0]), np.array([len(h)]))[0])

    def scan(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[dict]]:
        """Words per text, and what was found in each."""
        low = LOWER[buf]
        starts, ends, first = spans(low, offsets, ALNUM_LOWER)
        hashes = _WORD.words(low, starts, ends)
        text = low.tobytes()
        word = lambda k: text[starts[k] : ends[k]].decode("utf-8", "replace")
        found = [{"base": [], "base_labels": set(), "labels": set(), "score": 0.0, "places": set()} for _ in range(len(offsets) - 1)]
        tried: set[tuple[int, int]] = set()
        all_words: dict[int, list[str]] = {}
        for size, table in self.by_size.items():
            at, doc = window_starts(first, size)
            if not len(at):
                continue
            keys = _RUN.slices(hashes, at, at + size)
            for k in np.flatnonzero(self.filters[size][(keys & U((1 << _BITS) - 1)).astype(np.int64)]).tolist():
                for words, what in table.get(int(keys[k]), ()):
                    a, d = int(at[k]), int(doc[k])
                    if tuple(word(a + i) for i in range(size)) != words:
                        continue
                    out = found[d]
                    if isinstance(what, str):
                        out["base"].append(a - int(first[d]))
                        out["base_labels"].add(what)
                        out["labels"].add(what)
                        out["score"] = max(out["score"], 0.5)
                        continue
                    if d not in all_words:
                        all_words[d] = [word(i) for i in range(int(first[d]), int(first[d + 1]))]
                    place = a - int(first[d])
                    for start in range(max(0, place - what.reach), place + 1):
                        if (id(what), d, start) in tried:
                            continue
                        tried.add((id(what), d, start))
                        end, best = what.run(all_words[d], start)
                        if end >= 0:
                            out["labels"].add(what.label)
                            out["places"].add((start, end, what.label))
                            out["score"] = 1.0
                        else:
                            out["score"] = max(out["score"], min(1.0, best / what.mandatory) * 0.99)
        return np.diff(first), found


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``keep`` columns, n_words, n_base, first_word, last_word, base_labels, labels, score and places of every text.

    places lists (start word, end word, label) of accepted templates. The score
    is 1 if a template accepts, else the larger of one half for a base phrase
    and the best share of its wording that a template got through, else 0.
    Null and empty texts have no words; repeated rows stay; an empty table gives
    an empty result; columns beyond ``keep`` are dropped.
    """
    templates = templates or TEMPLATES
    part = docs.select(*keep, F.col(text).alias("_text"))
    names = ("n_words", "n_base", "first_word", "last_word")
    ddl = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<start:bigint,stop:bigint,label:string>>"
    more = docs.sparkSession.createDataFrame([], ddl).schema
    schema = part.drop("_text").schema
    for x in more:
        schema.add(x)
    place = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text"):
                n, found = scanner.scan(buf, offsets)
                columns = [
                    pa.array(n, pa.int64()), pa.array([len(x["base"]) for x in found], pa.int64()), pa.array([min(x["base"], default=None) for x in found], pa.int64()), pa.array([max(x["base"], default=None) for x in found], pa.int64()),
                    pa.array([",".join(sorted(x["base_labels"])) for x in found]), pa.array([",".join(sorted(x["labels"])) for x in found]), pa.array([x["score"] for x in found], pa.float64()),
                    pa.array([[{"start": a, "stop": b, "label": c} for a, b, c in sorted(x["places"])] for x in found], place),
                ]
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), *columns], names=[*keep, *names, "base_labels", "labels", "score", "places"])

    return part.mapInArrow(run, schema)
