"""License scans by template markup that is compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are always counted, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Templates: mandatory wording, ``[[optional]]`` regions and ``{{least-most}}`` replaceable regions of so many words.
TEMPLATES = {
    "mit": [
        "[[released|licensed|distributed|available]] under the [[terms of the]] mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "apache-2": [
        "licensed under the apache license version 2 [[0]]",
        "you may not use this file except in compliance with the license [[you may obtain a copy of the license at {{1-8}}]] unless required by applicable law or agreed to in writing",
    ],
    "cc-by-nc": ["licensed under [[a|the]] cc by nc [[sa|nd]] [[4|3|2|1]] [[0|5]]", "creative commons attribution noncommercial [[sharealike|noderivatives]] [[4|3|2|1]] [[0|5]]"],
    "cc-by": ["licensed under [[a|the]] cc by 4 0", "creative commons attribution 4 0 international"],
    "gpl-3": [
        "under the [[terms of the]] gnu general public license version 3",
        "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "bsd-3": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {{0-120}} neither the name of {{1-12}} nor the names of its contributors"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "proprietary": ["[[copyright {{1-8}}]] all rights reserved"],
}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def license_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


class Template:
    """A nondeterministic automaton over words.

    ``steps[s]`` has the words that lead on from state s; ``skips[s]`` the states that
    are reached without a word; ``free`` the states that any word leads on from.
    """

    def __init__(self, label: str, markup: str) -> None:
        self.label = label
        self.steps: list[dict[bytes, int]] = [{}]
        self.skips: list[set[int]] = [set()]
        self.free: dict[int, int] = {}
        self.mandatory: dict[int, int] = {}
        self.wording: list[bytes] = []
        end = self._sequence(markup.strip(), 0, required=True)
        self.end, self.total = end, len(self.wording)
        self.first = frozenset(w for s in self._closed({0}) for w in self.steps[s])
        if 0 in self.free or not self.wording:
            raise ValueError("a template starts with wording")

    def _state(self) -> int:
        self.steps.append({})
        self.skips.append(set())
        return len(self.steps) - 1

    def _sequence(self, markup: str, at: int, required: bool) -> int:
        for part in re.findall(r"\[\[.*?\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", markup):
            if part.startswith("[["):
                after = self._state()
                self.skips[at].add(after)
                for choice in part[2:-2].split("|"):
                    fork = self._state()
                    self.skips[at].add(fork)
                    self.skips[self._sequence(choice, fork, required=False)].add(after)
                at = after
            elif part.startswith("{{"):
                least, most = map(int, part[2:-2].split("-"))
                after = self._state()
                for i in range(most + 1):
                    if i >= least:
                        self.skips[at].add(after)
                    if i < most:
                        on = self._state()
                        self.free[at] = on
                        at = on
                at = after
            else:
                on = self._state()
                self.steps[at][part.encode()] = on
                if required:
                    self.wording.append(part.encode())
                    self.mandatory[on] = len(self.wording)
                at = on
        return at

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return out

    def run(self, words: list[bytes], at: int) -> tuple[int, int]:
        """End of the longest accepted stretch from ``at`` (or -1), and mandatory words matched on the best path."""
        states, end, best = self._closed({0}), -1, 0
        while states:
            best = max([best, *(self.mandatory.get(s, 0) for s in states)])
            if self.end in states:
                end = at
            if at == len(words):
                break
            states = self._closed({t for s in states for t in (self.steps[s].get(words[at]), self.free.get(s)) if t is not None})
            at += 1
        return end, best


class LicenseScanner:
    """Compiled templates and base phrases, for use within tasks."""

    def __init__(self, templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None) -> None:
        self.templates = [Template(label, m) for label, all_ in (TEMPLATES if templates is None else templates).items() for m in all_]
        self.base = [(phrase.encode().split(), label) for phrase, label in (BASE_PHRASES if base is None else base).items()]
        self.first = frozenset().union(*[t.first for t in self.templates])

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = license_words(text)
        there = set(words)
        places, found = [], []
        for phrase, label in self.base:
            if all(w in there for w in phrase):
                at = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]
                places += at
                found += [label] * bool(at)
        labels, score = set(found), 1.0 if found else 0.0
        starts: dict[bytes, list[int]] = {w: [] for w in self.first & there}
        for i, w in enumerate(words) if starts else ():
            if w in starts:
                starts[w].append(i)
        for template in self.templates:
            for w in template.first & starts.keys():
                for i in starts[w]:
                    end, best = template.run(words, i)
                    if end >= 0:
                        labels.add(template.label)
                    score = max(score, best / template.total if end < 0 else 1.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(set(found))), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """License labels of every text.

    Reads ``doc_id`` and ``text``. Returns one row per row: ``doc_id``, ``n_words``,
    ``n_base`` (places of base phrases), ``first_word`` and ``last_word`` (their smallest
    and largest start, null without one), ``base_labels``, ``labels`` (also those of
    templates whose mandatory wording matches exactly; sorted, comma-joined) and
    ``score`` (the largest share of a template's mandatory words that match in
    order from its start; 1.0 with a label).

    Null and empty texts have no words, no labels and score 0. Each row is judged by
    itself, so repeated rows, null ids and an empty table need no rule.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates, base)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            rows = [scanner.scan(x.as_py()) for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
