"""License scans: fuzzy search for short notices.

A text is normalised to lower-case words (runs of ASCII letters and digits and of all beyond ASCII)
joined by single spaces. Two searches run over it:

* base phrases: places where a phrase's words stand consecutively, overlapping ones included;
* notices, with up to k edits (insertions, deletions, substitutions of characters). The pattern is cut into k + 1
  pieces; by the pigeonhole principle a match with at most k edits holds one of them unchanged. One
  Aho-Corasick automaton finds all pieces of all notices in one pass; the window around each hit, in
  which a match may lie, goes by itself to the regex library's bounded-error matching, which reports span and
  number of edits. Windows are as long as the notice and its edits allow, so work grows with the text and its hits alone.
  Of spans of one notice that overlap, the one with the fewest edits is its place.

Matches begin and end at word borders. Base phrases are notices too, with few edits, so "apache licence"
is found; the method's own labels end in "-notice" or "~" (an inexact base phrase).
score is the best match's 1 - edits / length, 1 with a base place, 0 without any.

Defined results: null and empty texts have no words and no labels; whole texts are searched, very long ones in
linear time; of spans that overlap and tie in edits the first stays; repeated rows each get a row; an empty table gives none;
extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.common import column_bytes, lean, narrow, slices

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Phrases from public licenses' notices, and the edits allowed. ``scan`` takes other tables.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": ("mit-notice", 9),
    "the software is provided as is without warranty of any kind express or implied": ("as-is-notice", 7),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd-notice", 9),
    "neither the name of the copyright holder nor the names of its contributors may be used": ("bsd3-notice", 8),
    "you may not use this file except in compliance with the license": ("apache-notice", 6),
    "licensed under the apache license version 2 0": ("apache2-notice", 4),
    "you can redistribute it and or modify it under the terms of the gnu": ("gpl-notice", 6),
    "gnu lesser general public license": ("lgpl-notice", 3),
    "gnu affero general public license": ("agpl-notice", 3),
    "gnu free documentation license": ("gfdl-notice", 3),
    "this source code form is subject to the terms of the mozilla public license": ("mpl-notice", 7),
    "mozilla public license": ("mpl~", 2),
    "eclipse public license": ("epl-notice", 2),
    "common development and distribution license": ("cddl-notice", 4),
    "european union public licence": ("eupl-notice", 2),
    "boost software license": ("boost-notice", 2),
    "python software foundation license": ("psf-notice", 3),
    "this software is provided as is without any express or implied warranty": ("zlib-notice", 6),
    "permission to use copy modify and or distribute this software for any purpose": ("isc-notice", 7),
    "this is free and unencumbered software released into the public domain": ("unlicense-notice", 7),
    "do what the fuck you want to public license": ("wtfpl-notice", 4),
    "sil open font license": ("ofl-notice", 2),
    "microsoft public license": ("mspl-notice", 2),
    "the artistic license": ("artistic-notice", 1),
    "licensed under a creative commons attribution": ("cc-notice", 4),
    "creative commons attribution sharealike": ("cc-by-sa-notice", 3),
    "creative commons attribution noncommercial": ("cc-by-nc-notice", 4),
    "creative commons zero": ("cc0-notice", 2),
    "spdx license identifier": ("spdx-notice", 2),
    "all rights reserved": ("reserved-notice", 1),
    "gnu general public license": ("gpl~", 3),
    "apache license": ("apache~", 1),
    "mit license": ("mit~", 1),
}

NORMAL = bytes(32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if 65 <= b < 91 else b for b in range(256))


def pieces(pattern: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces with their places."""
    cuts = np.linspace(0, len(pattern), k + 2).astype(int).tolist()
    return [(a, pattern[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, tuple[str, int]]):
        import ahocorasick
        import regex

        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.notices = [(p, label, k, regex.compile(rf"(?b)(?<= )(?:{regex.escape(p, literal_spaces=True)}){{e<={k}}}(?= )")) for p, (label, k) in notices.items()]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (p, _, k, _) in enumerate(self.notices):
            for at, s in pieces(p, k):
                seeds.setdefault(s, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for s, where in seeds.items():
            self.seeds.add_word(s, (len(s), where))
        self.seeds.make_automaton()

    def base_places(self, text: bytes) -> list[tuple[int, str]]:
        """(place, label) of every place; text is normalised, with a space at either end."""
        out = []
        for p, label in self.base:
            at = text.find(p)
            while at >= 0:
                out.append((at, label))
                at = text.find(p, at + 1)
        return out

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of every notice's matches, each window searched for itself."""
        windows: dict[int, set[int]] = {}
        for end, (size, where) in self.seeds.iter(text):
            for i, at in where:
                windows.setdefault(i, set()).add(end + 1 - size - at)
        out = []
        for i, begins in windows.items():
            p, label, k, rx = self.notices[i]
            spans = set()
            for a in begins:
                if m := rx.search(text, max(0, a - k - 1), min(len(text), a + len(p) + k + 1)):
                    spans.add((m.start(), m.end(), sum(m.fuzzy_counts)))
            kept: list[tuple[str, int, int, int]] = []
            for a, b, edits in sorted(spans):
                if kept and a < kept[-1][2]:
                    if edits < kept[-1][3]:
                        kept[-1] = (label, a, b, edits)
                else:
                    kept.append((label, a, b, edits))
            out += kept
        return out


@lru_cache(4)
def scanner(base: tuple, notices: tuple) -> Scanner:
    return Scanner(dict(base), dict(notices))


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, tuple[str, int]] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans: (label, first word, words, edits) of every fuzzy match."""
    key = tuple(base.items()), tuple(notices.items())
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,word:long,words:long,edits:long>>"

    def run(batches):
        s = scanner(*key)
        for batch in batches:
            data, offs = column_bytes(batch.column(1))
            for a, b in slices(offs):
                rows: list[tuple] = []
                for i in range(a, b):
                    words = data[offs[i] : offs[i + 1]].tobytes().translate(NORMAL).split()
                    norm = b" " + b" ".join(words) + b" "
                    places = s.base_places(norm)
                    text = norm.decode("utf-8", "replace")
                    # an exact base phrase is no match of the method's own
                    found = [f for f in s.fuzzy(text) if f[3] or not f[0].endswith("~")]
                    labels = {x for _, x in places}
                    best = 1.0 if places else max((1 - e / max(q - p, 1) for _, p, q, e in found), default=0.0)
                    at = np.searchsorted(np.flatnonzero(np.frombuffer(norm, np.uint8) == 32), [p for p, _ in places]).tolist() if places else []
                    spans = []
                    if found:
                        gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
                        first, last = np.searchsorted(gaps, [p for _, p, _, _ in found]).tolist(), np.searchsorted(gaps, [q for _, _, q, _ in found]).tolist()
                        spans = [{"label": x, "word": f - 1, "words": g - f + 1, "edits": e} for (x, _, _, e), f, g in zip(found, first, last)]
                    rows.append((len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {f[0] for f in found})), max(0.0, best), spans))
                cols = list(zip(*rows))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("edits", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c, t) for c, t in zip(cols, types)]], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    return narrow(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), schema)
