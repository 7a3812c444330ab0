"""License scans: matching statistics of a text against license templates, chained into covered spans."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import table_operator, terms, with_text_columns

#: Phrases and the labels they stand for.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Label and an excerpt of the public license text or notice.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction including without limitation the"
     " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
     " persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial"
     " portions of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
     " with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is"
     " distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation either version 3 of the license or at your option"
     " any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the"
     " implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
     " the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the"
     " following disclaimer"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was"
     " not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
     " granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

FIELDS = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string",
    "labels": "string", "score": "double", "spans": "array<string>",
}


@dataclass(frozen=True)
class Match:
    """Words start..end of the text equal words at..at + end - start of a template."""

    start: int
    end: int
    template: int
    at: int


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences.

    A state stands for all substrings with the same end places; ``ends`` has, by sequence, the last word of each such
    place, for states whose longest substring has ``shortest`` tokens or more. ``whole`` has the phrases that are
    suffixes of the state's longest substring.
    """

    def __init__(self, sequences: Iterable[list[bytes]], shortest: int = 1) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        self.sequences = list(sequences)
        for number, sequence in enumerate(self.sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(number, []).append(place)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for state in order:
            if self.length[self.link[state]] >= shortest:
                above = self.ends[self.link[state]]
                for number, places in self.ends[state].items():
                    above[number] = sorted({*places, *above.get(number, ())})
        self.whole: list[tuple[int, ...]] = [()] * len(self.next)

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, state: int, token: bytes) -> int:
        """The state of the ``token`` edge of ``state``, made to hold just the next longer substring."""
        target = self.next[state][token]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: bytes) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        made = self._state(self.length[last] + 1)
        while last >= 0 and token not in self.next[last]:
            self.next[last][token] = made
            last = self.link[last]
        self.link[made] = 0 if last < 0 else self._split(last, token)
        return made

    def mark_phrases(self, phrases: list[list[bytes]]) -> None:
        """Note for each state which phrases end there; phrases are among the sequences."""
        own: dict[int, list[int]] = {}
        for number, phrase in enumerate(phrases):
            state = 0
            for token in phrase:
                state = self.next[state][token]
            own.setdefault(state, []).append(number)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            above = self.whole[self.link[state]] if state else ()
            self.whole[state] = (*above, *own.get(state, ()))


class LicenseScanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, min_match: int = 5, max_gap: int = 40, min_cover: float = 0.5):
        self.phrases = [terms(p.encode()) for p, _ in phrases]
        self.phrase_labels = [label for _, label in phrases]
        self.templates = [terms(t.encode()) for _, t in templates]
        self.template_labels = [label for label, _ in templates]
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.automaton = SuffixAutomaton([*self.templates, *self.phrases], min_match)
        self.automaton.mark_phrases(self.phrases)

    def read(self, found: list[bytes]) -> tuple[list[tuple[int, int]], list[Match]]:
        """Phrase places (start, phrase), and the maximal matches of at least ``min_match`` words."""
        a, places, matches = self.automaton, [], []
        following, link, length, whole = a.next, a.link, a.length, a.whole
        known, state, matched = following[0], 0, 0
        for i, word in enumerate(found):
            if word not in known:
                if matched >= self.min_match:
                    self._emit(state, matched, i, matches)
                state = matched = 0
                continue
            if word not in following[state]:
                if matched >= self.min_match:
                    self._emit(state, matched, i, matches)
                while word not in following[state]:
                    state = link[state]
                    matched = length[state]
            state = following[state][word]
            matched += 1
            for phrase in whole[state]:
                if len(self.phrases[phrase]) <= matched:
                    places.append((i + 1 - len(self.phrases[phrase]), phrase))
        if matched >= self.min_match:
            self._emit(state, matched, len(found), matches)
        return places, matches

    def _emit(self, state: int, matched: int, end: int, matches: list[Match]) -> None:
        """The match at each place of each template that holds it."""
        for template, places in self.automaton.ends[state].items():
            if template < len(self.templates):
                matches += [Match(end - matched, end, template, last + 1 - matched) for last in places]

    def chain(self, matches: list[Match]) -> list[tuple[int, int, int, float]]:
        """For each template the runs (template, first word, end, share of the template covered) over ``min_cover``.

        Matches with gaps of up to ``max_gap`` words form a run; in it, the chain that advances in text and
        template and covers most is found with a list of the best template ends, no longer than the template.
        """
        spans = []
        by_template: dict[int, list[Match]] = {}
        for m in matches:
            by_template.setdefault(m.template, []).append(m)
        for template, own in sorted(by_template.items()):
            own.sort(key=lambda m: (m.start, m.end))
            run: list[Match] = []
            for m in [*own, None]:
                if run and (m is None or m.start - run[-1].end > self.max_gap):  # ends rise as starts do
                    cover = self._best_chain(run) / len(self.templates[template])
                    if cover >= self.min_cover:
                        spans.append((template, run[0].start, run[-1].end, min(cover, 1.0)))
                    run = []
                if m is not None:
                    run.append(m)
        return spans

    @staticmethod
    def _best_chain(run: list[Match]) -> int:
        """Most template words that matches cover which follow each other; overlapping ends are cut.

        The same words of the text match one place of the template only: places of one stretch don't follow
        each other.
        """
        ends, covers = [0], [0]  # by rising template end, with rising cover
        for _, places in groupby(run, key=lambda m: (m.start, m.end)):
            reached = []
            for m in places:
                size = m.end - m.start
                k = bisect_right(ends, m.at) - 1
                best = covers[k] + size
                for j in range(k + 1, len(ends)):  # ends inside this match: only the rest counts
                    if ends[j] >= m.at + size:
                        break
                    best = max(best, covers[j] + m.at + size - ends[j])
                reached.append((m.at + size, best))
            for end, best in reached:
                k = bisect_right(ends, end)
                if covers[k - 1] < best:
                    while k < len(ends) and covers[k] <= best:
                        del ends[k], covers[k]
                    if ends[k - 1] == end:
                        covers[k - 1] = best
                    else:
                        ends.insert(k, end)
                        covers.insert(k, best)
        return covers[-1]

    def scan(self, text: bytes | None) -> tuple:
        found = terms(text)
        places, matches = self.read(found)
        spans = self.chain(matches)
        base = {self.phrase_labels[p] for _, p in places}
        labels = base | {self.template_labels[t] for t, *_ in spans}
        starts = [s for s, _ in places]
        score = 1.0 if base else max((cover for *_, cover in spans), default=0.0)
        shown = [f"{self.template_labels[t]}:{t}:{start}:{end}:{cover:.3f}" for t, start, end, cover in spans]
        return (
            len(found), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score, shown,
        )


#: Of a table of templates; the automaton in each task takes some hundred bytes for each word.
MAX_TEMPLATE_BYTES = 16 << 20


def templates_of(table: DataFrame, label: str = "label", text: str = "text") -> tuple[tuple[str, str], ...]:
    """Templates for a scanner from a table of whole license texts, by label, then text; they go to every task.

    Rows with a null label or text are left out, equal rows count once. More than MAX_TEMPLATE_BYTES bytes are refused.
    """
    rows = table.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(label, text).distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    if size > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes, more than {MAX_TEMPLATE_BYTES}")
    return tuple(sorted((r[0], r[1]) for r in rows.collect()))


@table_operator(FIELDS)
def scan_licenses(docs: DataFrame, text: str = "text", scanner: LicenseScanner | None = None) -> DataFrame:
    """Add license columns: n_words, places of the base phrases, labels, score and the covered template spans.

    Each whole text streams through the automaton once. ``spans`` has ``label:template:first word:end:cover``
    for every chained span that covers at least half of a template. ``score``: 1 where a base phrase stands,
    else the largest cover. Null and empty texts: no words, empty labels, score 0, null places. Repeated rows
    get the same answer; columns with these names are replaced, others stay; an empty table stays empty.
    """
    scanner = scanner or LicenseScanner()
    return with_text_columns(docs, text, FIELDS, scanner.scan)
