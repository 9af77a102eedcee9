"""Licence scanning with a generalised suffix automaton over words.

The automaton is built over all template texts (and the base phrases).  A
document's words stream through it and give matching statistics: for every
place, the length of the longest suffix that occurs in some template.  Base
phrases are recognised from the states; long matches are chained, template by
template, into covered spans, and a template covered far enough is a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases that are counted wherever their words stand consecutively.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Sentences of public licence notices, with the label they give.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-name": "licensed under the mit license",
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-name": "gnu general public license",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-sa": "licensed under cc by sa 4.0",
    "cc-by-4.0": "licensed under cc by 4.0",
    "cc-full": "this work is licensed under a creative commons attribution 4.0 international license",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "warranty": "the software is provided as is without warranty of any kind express or implied",
}

#: Bytes to words: A-Z in lower case, all but letters, digits and non-ASCII blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A match this long starts a chain; gaps up to GAP words may stand between matches.
LEAST_MATCH, GAP, COVERED = 2, 3, 0.8
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text lower-cased in A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class SuffixAutomaton:
    """Of several word sequences; states carry where in which sequence they end."""

    def __init__(self, sequences: dict[str, list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.sequences = sequences
        ends: list[set[tuple[str, int]]] = [set()]
        for name, words in sequences.items():
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word, ends)
                ends[last].add((name, at))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]

    def _new(self, length: int, link: int, arcs: dict[bytes, int], ends) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, parent: int, word: bytes, ends) -> int:
        """The state of parent + word, cloned when longer strings share it."""
        child = self.next[parent][word]
        if self.length[child] == self.length[parent] + 1:
            return child
        clone = self._new(self.length[parent] + 1, self.link[child], dict(self.next[child]), ends)
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, word: bytes, ends) -> int:
        if word in self.next[last]:
            return self._split(last, word, ends)
        state = self._new(self.length[last] + 1, 0, {}, ends)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            self.link[state] = self._split(at, word, ends)
        return state

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """``(place, state, length)`` wherever a suffix at the place matches."""
        alphabet = self.next[0]
        state = length = 0
        for at in [k for k, w in enumerate(words) if w in alphabet]:
            word = words[at]
            if length and previous != at - 1:
                state = length = 0
            previous = at
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state][word]
            length += 1
            yield at, state, length


class Scanner:
    def __init__(self, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None):
        self.phrases = BASE_PHRASES if phrases is None else phrases
        templates = TEMPLATES if templates is None else templates
        self.templates = {name: words_of(text) for name, text in templates.items()}
        bases = {f"base:{p}": words_of(p) for p in self.phrases}
        self.automaton = a = SuffixAutomaton(bases | self.templates)
        # Of each state, the phrases that are suffixes of what it stands for.
        self.found: list[list[tuple[int, str]]] = [[] for _ in a.link]
        for phrase, label in self.phrases.items():
            words, state = words_of(phrase), 0
            for w in words:
                state = a.next[state][w]
            for other in range(len(a.link)):
                up = other
                while up > 0 and up != state:
                    up = a.link[up]
                if up == state:
                    self.found[other].append((len(words), label))

    def scan(self, text: str | None) -> dict:
        """Counts, labels, score and ``spans``: (template, first word, last word, covered share)."""
        words = words_of(text)
        starts, base = [], set()
        ends = self.automaton.ends
        last: dict[str, list[int]] = {}  # per template: first word, last word, place in it, words covered
        spans = []

        def close(name: str) -> None:
            first, end, _, covered = last.pop(name)
            spans.append((name, first, end, covered / len(self.templates[name])))

        for at, state, length in self.automaton.statistics(words):
            for n, label in self.found[state]:
                if length >= n:
                    starts.append(at - n + 1)
                    base.add(label)
            if length < LEAST_MATCH:
                continue
            for name, end in ends[state]:
                if name not in self.templates:
                    continue
                chain = last.get(name)
                if chain and chain[1] == at - 1 and chain[2] == end - 1:
                    chain[1], chain[2], chain[3] = at, end, chain[3] + 1
                elif chain and chain[1] >= at:
                    continue
                elif chain and end - length + 1 > chain[2] and at - length - chain[1] <= GAP:
                    chain[1], chain[2], chain[3] = at, end, chain[3] + length
                else:
                    if chain:
                        if chain[3] >= length and at - chain[1] <= GAP:
                            continue
                        close(name)
                    last[name] = [at - length + 1, at, end, length]
        for name in list(last):
            close(name)
        spans = [x for x in spans if x[3] >= COVERED]
        labels = base | {name for name, *_ in spans}
        best = max((x[3] for x in spans), default=0.0)
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels)),
            "score": min(1.0, best) if spans else 0.5 * bool(base),
            "spans": spans,
        }


_SCANNER: list[Scanner] = []


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """Scan every whole text; one row a document, with its ``spans`` if asked for.

    Null and empty texts have no words, no labels and score 0.  Rows that
    repeat or lack an id are scanned each; an empty table gives no rows;
    further columns are not read.  One pass, no shuffle.
    """
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    schema = SCHEMA
    if spans:
        kinds.append(("spans", pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))))
        schema += ", spans array<struct<template:string,first:long,last:long,covered:double>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = _SCANNER[0].scan(text.as_py()) | {"doc_id": doc}
                row["spans"] = [dict(zip(("template", "first", "last", "covered"), x)) for x in row["spans"]]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return docs.select(id_col, text_col).mapInArrow(scan, schema)
