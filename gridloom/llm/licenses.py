"""License scans by template-markup matching.

A template is words with two kinds of markup: ``[...]`` is optional, ``{n}`` stands for up to n words of any kind.
Templates are compiled into one token automaton each; a text is accepted where the automaton passes from
its start to its end, so that all mandatory wording stands there exactly and in order. Matching starts only at words that can begin a
template. Base phrases are places where a phrase's words stand consecutively.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, small_batches, spark_of, texts

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices and license texts in template markup, by label; wording as published.
TEMPLATES = {
    "mit-notice": ["[this {6} is] released under the [terms of the] mit license", "[this {6} is] licensed under the [terms of the] mit license", "[this {6} is] distributed under the [terms of the] mit license"],
    "apache-2.0-notice": ["licensed under the apache license version 2 0 [the license you may not use this file except in compliance with the license]", "released under the apache license version 2 0"],
    "gpl-notice": ["licensed under the gnu general public license [version {1} [or [at your option any] later]]", "released under the gnu general public license"],
    "gpl-2.0-notice": ["under the terms of the gnu general public license [version 2] as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-3.0-notice": ["under the terms of the gnu general public license [version 3] as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl-notice": ["under the terms of the gnu lesser general public license [as published by the free software foundation]", "licensed under the [gnu] lgpl"],
    "mpl-2.0-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0 [if a copy of the mpl was not distributed with this file you can obtain one at [http|https] mozilla org mpl 2 0]", "[licensed|released] under the mozilla public license [version|v] 2 0"],
    "cc0-1.0": ["[licensed|released|dedicated] [to the public domain] under [the] [creative commons] cc0 1 0", "creative commons cc0 1 0 universal"],
    "cc-by-nc-4.0": ["[this {4} is] licensed under [the|a] [creative commons] cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"],
    "cc-by-sa-4.0": ["licensed under [the|a] [creative commons] cc by sa 4 0", "creative commons attribution sharealike 4 0 international"],
    "cc-by-4.0": ["licensed under [the] cc by 4 0", "creative commons attribution 4 0 international"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software"
    ],
    "isc-text": ["permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "zlib-text": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "bsd-text": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3] neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]"
    ],
}
ANY = b"*"


class Automaton:
    """Nodes hold (word, next) arcs; ``end`` is the accepting node. Empty arcs are resolved while compiling."""

    def __init__(self, template: str):
        self.arcs: list[list[tuple[bytes, int]]] = [[]]
        self.empty: list[set[int]] = [set()]
        items = re.findall(r"\[|\]|\||\{\d+\}|[^\s\[\]|{}]+", template)
        self.end, rest = self._sequence(items, 0, 0)
        if rest != len(items):
            raise ValueError(f"unbalanced markup: {template}")
        self.closed = [self._closure(n) for n in range(len(self.arcs))]
        self.start = self.closed[0]
        self.firsts = {w for n in self.start for w, _ in self.arcs[n]}

    def _node(self) -> int:
        self.arcs.append([])
        self.empty.append(set())
        return len(self.arcs) - 1

    def _sequence(self, items: list[str], at: int, node: int) -> tuple[int, int]:
        begin, ends = node, []
        while at < len(items) and items[at] != "]":
            item = items[at]
            at += 1
            if item == "[":
                inner, at = self._sequence(items, at, node)
                if at >= len(items):
                    raise ValueError("unbalanced markup")
                at += 1
                after = self._node()
                self.empty[inner].add(after)
                self.empty[node].add(after)
                node = after
            elif item == "|":
                ends.append(node)
                node = begin
            else:
                for _ in range(int(item[1:-1]) if item[0] == "{" else 1):
                    new = self._node()
                    self.arcs[node].append((ANY if item[0] == "{" else item.encode(), new))
                    if item[0] == "{":
                        self.empty[node].add(new)
                    node = new
        for e in ends:
            self.empty[e].add(node)
        return node, at

    def _closure(self, node: int) -> frozenset[int]:
        seen, todo = {node}, [node]
        while todo:
            for n in self.empty[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        return frozenset(seen)

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest acceptance from ``at``, or -1."""
        live, best = self.start, -1
        while live:
            if self.end in live:
                best = at
            if at >= len(words):
                break
            word = words[at]
            live = frozenset(m for n in live for w, to in self.arcs[n] if w == word or w == ANY for m in self.closed[to])
            at += 1
        return best


def word_table() -> bytes:
    """Byte translation: A-Z to lower case, all other ASCII than 0-9 and a-z to a space; the rest stands."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.table = word_table()
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
        self.automata = [(label, Automaton(t)) for label, many in templates.items() for t in many]
        self.by_first: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, a in self.automata:
            if ANY in a.firsts or a.end in a.start:
                raise ValueError(f"{label}: a template must begin with a word and not match nothing")
            for w in a.firsts:
                self.by_first.setdefault(w, []).append((label, a))
        #: A text without any of these words holds neither a phrase nor a template. A template without a word that every acceptance has
        #: gives the words that it can begin with.
        signs = {p[-1] for p, _ in self.phrases}
        for _, a in self.automata:
            needed = self._needed(a)
            signs |= {max(needed, key=lambda w: (len(w), w))} if needed else a.firsts
        self.signs = re.compile(b"|".join(map(re.escape, sorted(signs))) or b"(?!)")

    @staticmethod
    def _needed(a: Automaton) -> set[bytes]:
        """Words that every acceptance has: those whose arcs, taken away, leave no way to the end."""
        words = {w for arcs in a.arcs for w, _ in arcs if w != ANY}

        def passes(without: bytes) -> bool:
            seen, todo = set(a.start), list(a.start)
            while todo:
                for w, to in a.arcs[todo.pop()]:
                    if w != without:
                        new = a.closed[to] - seen
                        seen |= new
                        todo += new
            return a.end in seen

        return {w for w in words if not passes(w)}

    def __call__(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, int]]]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, template spans (label, first word, end)."""
        plain = text.encode("utf-8", "surrogatepass").translate(self.table)
        words = plain.split()  # spaces are the only ASCII white space that is left
        if not self.signs.search(plain):
            return len(words), 0, None, None, "", "", 0.0, []
        places, base, spans = [], set(), []
        for phrase, label in self.phrases:
            n, at = len(phrase), -1
            while True:
                try:
                    at = words.index(phrase[-1], at + 1)
                except ValueError:
                    break
                if at + 1 >= n and tuple(words[at + 1 - n : at + 1]) == phrase:
                    places.append(at + 1 - n)
                    base.add(label)
        for at, w in enumerate(words):
            for label, a in self.by_first.get(w, ()):
                end = a.match(words, at)
                if end >= 0:
                    spans.append((label, at, end))
        found = base | {s[0] for s in spans}
        # each label is evidence, one with an accepted template twice that of a phrase alone
        score = 1 - 1 / (1 + 2 * len({s[0] for s in spans}) + len(base))
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(found)), score, spans


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts, places, labels, score and the spans of accepted templates.

    A null text is empty and has no words, labels or places; its score is 0. Repeated rows and rows with a null id are scanned each by itself.
    Where a template is accepted from one place in several ways the longest counts. Spans come in order of their places, then of the catalogue.
    """
    small_batches(spark_of(docs))
    spans = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def make():
        scanner = Scanner(templates, phrases)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scanner(t or "") for t in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]
            out.append(pa.array([[{"label": x, "first_word": s, "end_word": e} for x, s, e in r] for r in cols[7]], spans))
            return pa.RecordBatch.from_arrays([b.column(0), *out], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

        return step

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long>>"
    return map_batches(texts(docs, id_col, text_col), make, schema)


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.drop("spans")


def pattern(template: str) -> str:
    """The template as a regular expression over words that a space stands before and after; both engines' syntax."""
    out = ""
    for item in re.findall(r"\[|\]|\||\{\d+\}|[^\s\[\]|{}]+", template):
        out += {"[": "(?:", "]": ")?", "|": "|"}.get(item) or (f"(?: [^ ]+){{0,{item[1:-1]}}}" if item[0] == "{" else " " + item)
    return f"(?:{out}) "


def oracle_sql(templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> str:
    """The same scan of ``documents`` in DuckDB SQL."""
    found = ", ".join(f"CASE WHEN regexp_matches(t, '{'|'.join(map(pattern, many))}') THEN '{label}' END" for label, many in templates.items())
    places = " || ".join(f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: ws[i:i + {len(p.split()) - 1}] = [{', '.join(repr(w) for w in p.split())}]), lambda i: {{'at': i - 1, 'label': '{label}'}})" for p, label in phrases.items())
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS t, {places} AS places FROM w),
l AS (SELECT *, list_distinct(list_transform(places, lambda x: x.label)) AS base, list_filter([{found}], lambda x: x IS NOT NULL) AS more FROM p)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(list_transform(places, lambda x: x.at))::BIGINT AS first_word, list_max(list_transform(places, lambda x: x.at))::BIGINT AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || more)), ',') AS labels, 1 - 1::DOUBLE / (1 + 2 * len(more) + len(base)) AS score FROM l
"""
