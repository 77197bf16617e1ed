"""License scans: an inverted index of the templates' words picks the places where enough of
a template's words stand close together, and a banded alignment at each of them tells how
much of the template stands in the text, and where."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from topictide.llm.common import ALNUM_LOWER, WordHashes, map_texts

# Notices as they are commonly given.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."],
    "BSD": [
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
}


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_LOWER).split() if text else []


@dataclass
class Index:
    """Templates as word hashes, and which word stands how often in which template (rows as
    ``words``, a last one for all others). Its size is that of the templates."""

    names: list[str]
    templates: list[np.ndarray]
    words: np.ndarray
    counts: np.ndarray


def build_index(templates: dict[str, list[str]] = TEMPLATES) -> Index:
    """Templates without words are refused."""
    hashes, names, bodies = WordHashes(), [], []
    for name, texts in templates.items():
        for text in texts:
            h = hashes(words_of(text.encode()))
            if not len(h):
                raise ValueError(f"template of {name} has no words")
            names.append(name)
            bodies.append(h)
    words = np.unique(np.concatenate(bodies))
    counts = np.zeros((len(words) + 1, len(bodies)), np.int64)
    for t, h in enumerate(bodies):
        np.add.at(counts[:, t], np.searchsorted(words, h), 1)
    return Index(names, bodies, words, counts)


def candidates(index: Index, flat: np.ndarray, n: np.ndarray, least: float, band: int) -> dict[int, list[tuple[int, int]]]:
    """By text the (template, shift) whose alignment can match ``least`` of the template:
    within the band stand as many of its words, each counted as often as it has it. Texts
    lie one after another, ``n`` words each."""
    vocabulary = len(index.words)
    at = np.searchsorted(index.words, flat)
    at[at == vocabulary] = 0
    # Before each text ``band`` places stand for shifts below 0.
    size = n + band
    first = np.cumsum(size) - size
    ids = np.full(int(size.sum()), vocabulary)
    ids[np.repeat(first + band - (np.cumsum(n) - n), n) + np.arange(len(flat))] = np.where(index.words[at] == flat, at, vocabulary)
    known = np.flatnonzero(ids < vocabulary)
    found: dict[int, list[tuple[int, int]]] = {}
    if not len(known):
        return found
    for t, body in enumerate(index.templates):
        need = int(np.ceil(least * len(body) - 1e-9))
        places = known[index.counts[ids[known], t] > 0]  # of words the template has
        if len(places) < need:
            continue
        # A window of shift p - first - band reaches from p - band to p + len(body) + band.
        reach = len(body) + 2 * band
        dense = places[:len(places) - need + 1][places[need - 1:] - places[:len(places) - need + 1] <= reach]
        last = places[need - 1:][places[need - 1:] - places[:len(places) - need + 1] <= reach]
        if not len(dense):
            continue
        # The window of p holds places from dense to last.
        change = np.zeros(len(ids) + 1, np.int64)
        lo, hi = np.maximum(last - len(body) - band, 0), np.minimum(dense + band, len(ids) - 1)
        np.add.at(change, lo, 1)
        np.add.at(change, hi + 1, -1)
        starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        doc = np.searchsorted(first, starts, "right") - 1
        for part in np.array_split(np.arange(len(starts)), len(starts) * (reach + 1) // 4_000_000 + 1):
            begin = np.maximum(starts[part] - band, first[doc[part]])
            end = np.minimum(starts[part] + len(body) + band + 1, first[doc[part]] + size[doc[part]])
            window = begin[:, None] + np.arange(reach + 1)[None, :]
            held = np.where(window < end[:, None], ids[np.minimum(window, len(ids) - 1)], vocabulary)
            total = np.zeros(len(part), np.int64)
            for w in np.flatnonzero(index.counts[:, t]).tolist():
                total += np.minimum((held == w).sum(axis=1), index.counts[w, t])
            for p, d in zip(starts[part][total >= need].tolist(), doc[part][total >= need].tolist()):
                found.setdefault(d, []).append((t, p - int(first[d]) - band))
    return found


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, start, stop) of the best alignment of the template within ``band``
    words of the diagonal ``shift`` (text place less template place). A match counts 1,
    a word that differs or is left out costs a half, text before and after is free."""
    width = 2 * band + 1
    lost = -1e9
    n = len(text)
    # A cell: score, matched words, first matched place, place after the last matched word.
    row = [(0.0, 0, -1, -1) if 0 <= shift + d <= n else (lost, 0, -1, -1) for d in range(-band, band + 1)]
    for i, word in enumerate(template.tolist()):
        fresh = []
        for d in range(width):
            j = i + 1 + shift + d - band  # words of the text before this cell's end
            best = (lost, 0, -1, -1)
            if 0 <= j <= n:
                if j > 0:
                    s, m, a, b = row[d]
                    if text[j - 1] == word:
                        best = (s + 1, m + 1, a if a >= 0 else j - 1, j)
                    else:
                        best = (s - 0.5, m, a, b)
                if d + 1 < width and row[d + 1][0] - 0.5 > best[0]:
                    s, m, a, b = row[d + 1]
                    best = (s - 0.5, m, a, b)
                if d > 0 and fresh[d - 1][0] - 0.5 > best[0]:
                    s, m, a, b = fresh[d - 1]
                    best = (s - 0.5, m, a, b)
                if best[0] < 0 and best[1] == 0:
                    best = (best[0], 0, -1, -1)
            fresh.append(best)
        row = fresh
    _, matched, start, stop = max(row, key=lambda c: (c[0], c[1], -c[2]))
    return matched, start, stop


def matches_of(index: Index, text: np.ndarray, places: list[tuple[int, int]], least: float, band: int) -> list[dict]:
    """Matches of a text from its (template, shift) candidates."""
    found = set()
    for template, shift in places:
        body = index.templates[template]
        lo = max(shift - band, 0)
        part = text[lo:max(shift + len(body) + band + 1, lo)]
        matched, start, stop = align(body, part, shift - lo, band)
        if matched >= least * len(body):
            found.add((matched, matched / len(body), index.names[template], start + lo, stop + lo))
    kept: list[dict] = []
    for matched, coverage, name, start, stop in sorted(found, key=lambda f: (-f[0], -f[1], f[4] - f[3], f[2], f[3])):
        if all(min(stop, k["stop"]) - max(start, k["start"]) <= 0.5 * (stop - start) for k in kept):
            kept.append({"license": name, "coverage": coverage, "matched": matched, "start": start, "stop": stop})
    return sorted(kept, key=lambda k: (k["start"], k["license"]))


def scan(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75,
         band: int = 6) -> DataFrame:
    """(id, license, coverage, matched_words, start, stop): a row for every notice found.

    A text is a candidate wherever enough of a template's words stand within reach; it is
    aligned there with a band of ``band`` words, and reported if at least ``least`` of the
    template's words match in order. Coverage is that share; the span is in words. Of
    matches over the same words the one with most matched words stays, then the larger
    share, then the shorter span, then the first name. Null and empty texts and texts without notices give no
    rows; repeated rows give theirs again. The index has the size of the templates, which
    are a parameter, and is sent to all tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(index or build_index())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, license string, coverage double, matched_words long, start long, stop long"

    def make():
        known, hashes = sent.value, WordHashes()

        def run(keys, texts):
            words = [words_of(t) for t in texts]
            n = np.array([len(w) for w in words], np.int64)
            flat = hashes([w for ws in words for w in ws])
            first = np.cumsum(n) - n
            out: dict[str, list] = {c: [] for c in ("doc_id", "license", "coverage", "matched_words", "start", "stop")}
            for d, places in candidates(known, flat, n, least, band).items():
                for m in matches_of(known, flat[first[d]:first[d] + n[d]], places, least, band):
                    for c, v in zip(out, (keys[d], m["license"], m["coverage"], m["matched"], m["start"], m["stop"])):
                        out[c].append(v)
            return out

        return run

    return map_texts(docs, id_col, text_col, schema, make).withColumnRenamed("doc_id", id_col)
