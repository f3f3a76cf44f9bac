"""License scans by templates whose markup compiles to token automata.

A template is plain wording with ``<<beginOptional>> … <<endOptional>>`` around regions a text may leave out, and
``<<var;words=m..n>>`` where it may put m to n words of its own. Everything else is mandatory and must match word by word.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palisade.llm.batches import DOUBLE, LONG, with_text_columns
from palisade.llm.words import ALPHANUMERIC, hash_spans, split_words

# fixed values: phrases whose consecutive words mark a license, and their labels
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label, family of the phrase it refines (or none), template
TEMPLATES = (
    ("gpl-3.0", "gpl", "<<beginOptional>>This <<var;words=1..3>> is<<endOptional>> licensed under <<beginOptional>>the terms of<<endOptional>> the "
     "GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, "
     "<<beginOptional>>either<<endOptional>> version 3<<beginOptional>>.0<<endOptional>>"),
    ("gpl-2.0", "gpl", "licensed under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License"
     "<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 2"
     "<<beginOptional>>.0<<endOptional>>"),
    ("apache-2.0", "apache", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc-4.0", "cc-by", "Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons <<endOptional>>"
     "CC BY-NC 4.0<<beginOptional>> International<<endOptional>>"),
    ("cc-by-4.0", "cc-by", "Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons <<endOptional>>"
     "CC BY 4.0<<beginOptional>> International<<endOptional>>"),
    ("mit-notice", "mit", "<<beginOptional>>Released<<endOptional>> under the <<beginOptional>>terms of the <<endOptional>>MIT License"),
    ("mit-text", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
     "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
     "<<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software."),
    ("isc-text", "", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with "
     "or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-text", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)\.\.(\d+))>>")


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class Automaton:
    """States are numbers; ``moves`` holds word edges (None: any word), ``skips`` edges that read nothing; the last state accepts."""

    def __init__(self, template: str):
        self.moves: list[dict[str | None, int]] = [{}]
        self.skips: list[list[int]] = [[]]
        self.mandatory = 0
        opened: list[int] = []
        at = 0
        for mark in [*_MARK.finditer(template), None]:
            for w in words_of(template[at:mark.start() if mark else len(template)]):
                self._word(w)
                self.mandatory += not opened
            if mark is None:
                break
            at = mark.end()
            if mark[1] == "beginOptional":
                opened.append(len(self.moves) - 1)
            elif mark[1] == "endOptional":
                self._skip(opened.pop())
            else:
                least, most = int(mark[2]), int(mark[3])
                begun = []
                for i in range(most):
                    if i >= least:
                        begun.append(len(self.moves) - 1)
                    self._word(None)
                for s in begun:
                    self._skip(s)
                self.mandatory += least * (not opened)
        if opened or not self.mandatory:
            raise ValueError("a template needs mandatory words and closed regions")

    def _word(self, w: str | None) -> None:
        self.moves[-1][w] = len(self.moves)
        self.moves.append({})
        self.skips.append([])

    def _skip(self, begun: int) -> None:
        self.skips[begun].append(len(self.moves) - 1)

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def first_words(self) -> set[str]:
        return {w for s in self.closure({0}) for w in self.moves[s] if w is not None}

    def match(self, words) -> int:
        """Words read by the longest accepted start of ``words``; 0 if none."""
        now, longest = self.closure({0}), 0
        for i, w in enumerate(words):
            now = self.closure({t for s in now for t in (self.moves[s].get(w), self.moves[s].get(None)) if t is not None})
            if not now:
                break
            if len(self.moves) - 1 in now:
                longest = i + 1
        return longest


class Scanner(NamedTuple):
    automata: list[tuple[str, str, Automaton]]
    phrases: list[tuple[str, list[bytes], np.ndarray]]
    starts: np.ndarray
    by_first: dict[bytes, list[int]]


def _hash_words(words: list[bytes]) -> np.ndarray:
    found = split_words([b" ".join(words)], ALPHANUMERIC)
    return hash_spans(found.data, found.start, found.end)



def scanner(templates: tuple = TEMPLATES, phrases: tuple = tuple(PHRASES.items())) -> Scanner:
    automata = [(label, family, Automaton(t)) for label, family, t in templates]
    by_first: dict[bytes, list[int]] = {}
    for i, (_, _, a) in enumerate(automata):
        for w in a.first_words():
            by_first.setdefault(w.encode(), []).append(i)
    worded = [(label, [w.encode() for w in p.split()], _hash_words([w.encode() for w in p.split()])) for p, label in phrases]
    return Scanner(automata, worded, np.sort(_hash_words(sorted(by_first))) if by_first else np.zeros(0, np.uint64), by_first)


def scan_texts(texts: list[bytes], scan: Scanner) -> list[dict]:
    """Words, phrase places and template spans ``(label, first word, end word)`` of each text."""
    found = split_words(texts, ALPHANUMERIC)
    hashes = hash_spans(found.data, found.start, found.end)
    out = [{"n_words": int(b - a), "base": [], "templates": []} for a, b in zip(found.first, found.first[1:], strict=False)]

    def owner(i: int) -> int:
        return int(np.searchsorted(found.first, i, "right")) - 1

    for label, parts, wanted in scan.phrases:
        k = len(parts)
        if len(hashes) < k:
            continue
        hit = hashes[:len(hashes) - k + 1] == wanted[0]
        for j in range(1, k):
            hit &= hashes[j:len(hashes) - k + 1 + j] == wanted[j]
        for i in np.flatnonzero(hit):
            text = owner(i)
            if i + k <= found.first[text + 1] and all(found.word(i + j) == p for j, p in enumerate(parts)):
                out[text]["base"].append((label, int(i - found.first[text])))
    for i in np.flatnonzero(np.isin(hashes, scan.starts)):
        text = owner(i)
        rest = range(i, int(found.first[text + 1]))
        for a in scan.by_first.get(found.word(i), ()):
            label, _, automaton = scan.automata[a]
            if n := automaton.match(found.word(j).decode("utf-8", "replace") for j in rest):
                out[text]["templates"].append((label, int(i - found.first[text]), int(i - found.first[text]) + n))
    for x in out:
        x["templates"].sort(key=lambda t: (t[1], t[0]))
    return out


def confidence(found: dict, scan: Scanner) -> float:
    """1 if a template is accepted; else the largest share of its family's shortest mandatory wording that a phrase covers."""
    if found["templates"]:
        return 1.0
    best = 0.0
    for label, parts, _ in scan.phrases:
        if any(b[0] == label for b in found["base"]):
            shortest = min((a.mandatory for _, family, a in scan.automata if family == label), default=len(parts))
            best = max(best, min(1.0, 0.9 * len(parts) / shortest))
    return best


_PLACE = pa.struct([("label", pa.string()), ("word", pa.int64())])
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
ADDED = {
    "license_words": LONG,
    "license_base": ("array<struct<label:string,word:long>>", pa.list_(_PLACE)),
    "license_spans": ("array<struct<label:string,first:long,end:long>>", pa.list_(_SPAN)),
    "license_score": DOUBLE,
}


def license_scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                 templates: tuple = TEMPLATES, phrases: tuple = tuple(PHRASES.items())) -> DataFrame:
    """Rows with ``license_words``, ``license_base`` (label, word), ``license_spans`` (label, first, end), ``license_score``.

    A null text counts as empty: no words, no places, score 0. Rows are independent: repeated rows get equal results, an empty
    table gives an empty table. The added columns replace columns of the same name; ``keep`` names the others that stay.
    """
    def start():
        scan = scanner(templates, phrases)

        def compute(texts: list[bytes]) -> dict[str, list]:
            found = scan_texts(texts, scan)
            return {
                "license_words": [x["n_words"] for x in found],
                "license_base": [[{"label": a, "word": b} for a, b in sorted(x["base"], key=lambda p: (p[1], p[0]))] for x in found],
                "license_spans": [[{"label": a, "first": b, "end": c} for a, b, c in x["templates"]] for x in found],
                "license_score": [confidence(x, scan) for x in found],
            }
        return compute

    return with_text_columns(docs, text, ADDED, start, keep)
