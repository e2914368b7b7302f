"""License scan by template-markup matching.

A template is wording with marked regions: ``<<opt>> ... <</opt>>`` may be
absent, ``<<alt>> a <<or>> b <</alt>>`` is one of its wordings, ``<<var N>>``
stands for 0 to N words of any kind.  It is compiled into an automaton over
tokens (words).  A text is accepted where a run of its words takes the
automaton from start to end, so every mandatory word must be there, in order
and unchanged; only marked regions may differ.

Cost: texts are split once at byte level; an automaton runs only where a
template's anchor stands (its longest mandatory run, which an accepted text
must hold), from the few words before it at which an accepted run can begin.

Defined results: a null or empty text has no words, no labels and score 0; a
null doc_id passes through; repeated rows are scanned each on their own; no
rows give no rows.  A very long text is scanned whole, in time proportional to
its length and the number of its anchors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from arcweave.llm.common import map_rows

#: Phrases of the base scan and their labels (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Templates of public license texts and notices, by label (fixed values).
TEMPLATES = {
    "agpl-3-notice": (
        "<<alt>> free software you can redistribute it and or modify it <<or>> licensed <<or>> released <<or>> distributed <</alt>> under the "
        "<<opt>> terms of the <</opt>> gnu affero general public license <<opt>> as published by the free software foundation <</opt>> <<opt>> either <</opt>> version 3"
    ),
    "apache-2-notice": "<<alt>> licensed <<or>> released <<or>> distributed <</alt>> under the <<opt>> terms of the <</opt>> apache license version 2 0",
    "apache-2-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at <<var 8>> unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license"
    ),
    "boost-1-text": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met <<opt>> 1 <</opt>> redistributions of source code must retain the <<opt>> above <</opt>> "
        "copyright notice this list of conditions and the following disclaimer <<opt>> 2 <</opt>> redistributions in "
        "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution"
    ),
    "bsd-3-text": (
        "in the documentation and or other materials provided with the distribution <<opt>> 3 <</opt>> neither the name of <<var 12>> "
        "nor the names of <<alt>> its <<or>> his <<or>> their <<or>> the <</alt>> contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission"
    ),
    "cc-by-nc-notice": "<<alt>> licensed <<or>> released <<or>> shared <</alt>> under <<opt>> <<alt>> a <<or>> the <</alt>> <</opt>> cc by nc",
    "cc-by-notice": (
        "<<alt>> licensed <<or>> released <<or>> shared <</alt>> under <<opt>> <<alt>> a <<or>> the <</alt>> <</opt>> creative commons attribution "
        "<<alt>> 2 0 <<or>> 2 5 <<or>> 3 0 <<or>> 4 0 <</alt>> <<var 1>> license"
    ),
    "cc-by-sa-notice": (
        "<<alt>> licensed <<or>> released <<or>> shared <</alt>> under <<opt>> <<alt>> a <<or>> the <</alt>> <</opt>> "
        "<<alt>> cc by sa <<or>> creative commons attribution share alike <<or>> creative commons attribution sharealike <</alt>>"
    ),
    "cc0-text": "to the extent possible under law <<var 12>> waived all copyright and related or neighboring rights to <<var 12>> work",
    "epl-2-notice": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license <<alt>> v 2 0 <<or>> 2 0 <<or>> v2 0 <</alt>>"
    ),
    "gpl-2-notice": (
        "<<alt>> free software you can redistribute it and or modify it <<or>> licensed <<or>> released <<or>> distributed <</alt>> under the "
        "<<opt>> terms of the <</opt>> gnu general public license <<opt>> as published by the free software foundation <</opt>> <<opt>> either <</opt>> version 2"
    ),
    "gpl-3-notice": (
        "<<alt>> free software you can redistribute it and or modify it <<or>> licensed <<or>> released <<or>> distributed <</alt>> under the "
        "<<opt>> terms of the <</opt>> gnu general public license <<opt>> as published by the free software foundation <</opt>> <<opt>> either <</opt>> version 3"
    ),
    "isc-text": (
        "permission to use copy modify and <<opt>> or <</opt>> distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "lgpl-notice": (
        "<<alt>> free software you can redistribute it and or modify it <<or>> licensed <<or>> released <<or>> distributed <</alt>> under the "
        "<<opt>> terms of the <</opt>> gnu <<alt>> lesser <<or>> library <</alt>> general public license"
    ),
    "mit-notice": (
        "<<alt>> licensed <<or>> released <<or>> distributed <<or>> available <<or>> provided <<or>> published <</alt>> under the <<opt>> terms of the <</opt>> mit license"
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice <<opt>> including the next paragraph <</opt>> shall be included "
        "in all copies or substantial portions of the software the software is provided as is without warranty of any "
        "kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall <<var 20>> be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
        "software or the use or other dealings in the software"
    ),
    "mpl-2-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at <<opt>> <<alt>> http <<or>> https <</alt>> <</opt>> mozilla org mpl 2 0"
    ),
    "unlicense-text": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
        "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
    ),
    "wtfpl-text": "do what the fuck you want to public license <<var 40>> everyone is permitted to copy and distribute verbatim or modified copies of this license document",
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
        "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to "
        "alter it and redistribute it freely subject to the following restrictions"
    ),
}

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

Node = tuple  # ("word", w) | ("opt", [nodes]) | ("alt", [[nodes], ...]) | ("var", n)


def parse(template: str) -> list[Node]:
    """The tree of a template's words and regions."""
    tokens = re.findall(r"<<[^<>]*>>|\S+", template)

    def nodes(i: int, ends: tuple[str, ...]) -> tuple[list[Node], int]:
        """The nodes from the i-th token up to one of ``ends``, and that one's place."""
        out: list[Node] = []
        while i < len(tokens) and tokens[i] not in ends:
            token = tokens[i]
            if token == "<<opt>>":
                body, i = nodes(i + 1, ("<</opt>>",))
                out.append(("opt", body))
            elif token == "<<alt>>":
                wordings = []
                while token != "<</alt>>":
                    body, i = nodes(i + 1, ("<<or>>", "<</alt>>"))
                    wordings.append(body)
                    token = tokens[i]
                out.append(("alt", wordings))
            elif m := re.fullmatch(r"<<var (\d+)>>", token):
                out.append(("var", int(m[1])))
            elif token.startswith("<<"):
                raise ValueError(f"unknown markup or the end of a region that never began: {token}")
            else:
                out.append(("word", token))
            i += 1
        if ends and i >= len(tokens):
            raise ValueError("a region never ends")
        return out, i

    return nodes(0, ())[0]


def most_words(tree: list[Node]) -> int:
    """The most words that nodes can take."""
    size = {"word": lambda v: 1, "var": lambda v: v, "opt": most_words, "alt": lambda v: max(map(most_words, v))}
    return sum(size[kind](value) for kind, value in tree)


def word_places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word places (from 0) of a phrase in " w1 w2 ... wn ", both with blanks at their ends."""
    at, words, counted = joined.find(phrase), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        yield words
        at = joined.find(phrase, at + 1)


class Automaton:
    """Epsilon-free automaton over words; state 0 is the start."""

    def __init__(self, template: str):
        tree = parse(template)
        # arcs[s]: (word or None for any, target); eps[s]: targets reached without a word
        self._arcs: list[list[tuple[bytes | None, int]]] = [[]]
        self._eps: list[list[int]] = [[]]
        end = self._build(tree, 0)
        closed = [self._closure(s) for s in range(len(self._arcs))]
        self.start = closed[0]
        self.accepts = [end in c for c in closed]
        self.step: list[dict[bytes, tuple[int, ...]]] = []
        self.any: list[tuple[int, ...]] = []
        for s in range(len(self._arcs)):
            words: dict[bytes, set[int]] = {}
            wild: set[int] = set()
            for w, t in self._arcs[s]:
                (wild if w is None else words.setdefault(w, set())).update(closed[t])
            self.step.append({w: tuple(sorted(v)) for w, v in words.items()})
            self.any.append(tuple(sorted(wild)))
        runs: list[tuple[list[bytes], int]] = [([], 0)]
        for i, (kind, value) in enumerate(tree):
            if kind == "word":
                runs[-1][0].append(value.encode())
            else:
                runs.append(([], i + 1))
        best, place = max(runs, key=lambda r: len(b" ".join(r[0])))
        if not best:
            raise ValueError("a template needs a mandatory word")
        self.anchor = b" " + b" ".join(best) + b" "
        self.before = most_words(tree[:place])

    def _new(self) -> int:
        self._arcs.append([])
        self._eps.append([])
        return len(self._arcs) - 1

    def _build(self, nodes: list[Node], s: int) -> int:
        for kind, value in nodes:
            t = self._new()
            if kind == "word":
                self._arcs[s].append((value.encode(), t))
            elif kind == "opt":
                self._eps[s].append(t)
                self._eps[self._build(value, s)].append(t)
            elif kind == "alt":
                for wording in value:
                    self._eps[self._build(wording, s)].append(t)
            else:
                for _ in range(value):
                    self._eps[s].append(t)
                    n = self._new()
                    self._arcs[s].append((None, n))
                    s = n
                self._eps[s].append(t)
            s = t
        return s

    def _closure(self, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in self._eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def accepts_at(self, words: list[bytes], i: int) -> bool:
        """Whether some run of words from the i-th on is accepted."""
        now = self.start
        while True:
            if any(self.accepts[s] for s in now):
                return True
            if i >= len(words) or not now:
                return False
            w, nxt = words[i], set()
            for s in now:
                nxt.update(self.step[s].get(w, ()))
                nxt.update(self.any[s])
            now, i = nxt, i + 1

    def found(self, words: list[bytes], joined: bytes) -> bool:
        """Whether some run of words is accepted: it holds the anchor, at most ``before`` words after its start."""
        tried = 0
        for place in word_places(joined, self.anchor):
            for i in range(max(tried, place - self.before), place + 1):
                if self.accepts_at(words, i):
                    return True
            tried = place + 1
        return False


def scanner(phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None):
    """A function from a text's bytes to its scan."""
    look = [(b" " + p.encode() + b" ", label) for p, label in (PHRASES if phrases is None else phrases).items()]
    automata = {k: Automaton(t) for k, t in (TEMPLATES if templates is None else templates).items()}

    def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = text.translate(_FOLD).split()
        joined = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in look:
            found = list(word_places(joined, phrase))
            places += found
            base |= {label} if found else set()
        matched = {k for k, a in automata.items() if a.found(words, joined)}
        score = 1.0 if matched else 0.5 if base else 0.0
        return (
            len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | matched)), score,
        )

    return scan


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, places and labels.

    ``score`` is 1 where a template is accepted, 0.5 where only a base phrase
    stands, else 0.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]

    def rows(got, n):
        scan = scanner(phrases, templates)
        out = list(zip(*map(scan, got["text"]), strict=True)) or [()] * len(names)
        return {"doc_id": got["doc_id"]} | dict(zip(names, out, strict=True))

    return map_rows(docs.select("doc_id", "text"), SCHEMA, rows)


def template_regex(template: str) -> str:
    """The template as a regular expression over " w1 w2 ... wn ", for tests and SQL."""

    def of(nodes: list[Node]) -> str:
        parts = []
        for kind, value in nodes:
            if kind == "word":
                parts.append(f"{value} ")
            elif kind == "opt":
                parts.append(f"(?:{of(value)})?")
            elif kind == "alt":
                parts.append(f"(?:{'|'.join(map(of, value))})")
            else:
                parts.append(f"(?:[^ ]+ ){{0,{value}}}")
        return "".join(parts)

    return " " + of(parse(template))
