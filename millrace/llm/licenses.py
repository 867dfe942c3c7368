"""License scan by a positional index of rare licence words.

The templates' words are weighted by inverse document frequency, counted over all scanned texts and
the templates; the rarest half of each template's words is indexed with its places.  A text's
words look their postings up, and a template is a candidate where enough of its rare words agree on
a relative position (place in text - place in template), give or take a band.  Then its mandatory
key phrases must stand there, in order.  The band lets item numbers, names and missing words shift
what follows.  Words that begin consecutive lines alike, as comment markers do, are read both with
and without.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _tokens as tk
from millrace.llm._shared import Rows, with_computed

#: Phrases whose places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed values: (label, text of the notice, key phrases that must stand in it).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("mit", "Released under the MIT License.", ["released under the mit license"]),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["you may not use this file except in compliance with the license"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache license version 2 0"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ["redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["for any purpose with or without fee is hereby granted"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["under the terms of the gnu general public license"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license version 3"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["subject to the terms of the mozilla public license"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ["cc by sa"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["free and unencumbered software released into the public domain"]),
    ("boost", "Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["boost software license", "obtaining a copy of the software and accompanying documentation"]),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ["the authors or copyright holders be liable for any claim", "the use or other dealings in the software"]),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ["software distributed under the license is distributed on an as is basis", "the specific language governing permissions and limitations"]),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES", ["and any express or implied warranties including but not limited to", "direct indirect incidental special exemplary or consequential damages"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["contributors may be used to endorse or promote products derived from this software"]),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["gnu affero general public license"]),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ["distributed in the hope that it will be useful", "see the gnu general public license for more details"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ["in no event will the authors be held liable", "to alter it and redistribute it freely"]),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ["eclipse public license"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ["waived all copyright and related or neighboring rights"]),
]

#: Share of a template's distinct words that are indexed, its rarest, and how many at least.
RARE_SHARE, RARE_LEAST = 0.5, 3
#: Least share of a template's rare words that agree on a band of relative positions.
AGREE = 0.6
#: A band's relative positions to each side: a share of the template's words, and the least.
BAND_SHARE, BAND_LEAST = 0.25, 4


def _hashes(text: str) -> np.ndarray:
    return tk.Words(pa.array([text]), tk.ALNUM_WORDS, lower=True).hashes()


class RareWordIndex:
    """Postings (word hash -> template, place) of the templates' rare words, and their key phrases.

    counts: texts that hold a word, by its hash, among n_texts; the templates count as texts too.
    """

    def __init__(self, templates=TEMPLATES, counts: dict[int, int] | None = None, n_texts: int = 0, phrases=PHRASES):
        self.labels = [t[0] for t in templates]
        words = [_hashes(t[1]) for t in templates]
        held = np.concatenate([np.unique(w) for w in words])
        distinct, own = np.unique(held, return_counts=True)
        frequency = own + np.array([(counts or {}).get(int(x), 0) for x in tk.as_long(distinct)])
        idf = np.log(1 + (n_texts + len(templates)) / frequency)
        postings: list[tuple[np.ndarray, ...]] = []
        for t, w in enumerate(words):
            weight = idf[np.searchsorted(distinct, w)]
            kinds, first = np.unique(w, return_index=True)
            rarest = kinds[np.lexsort((first, -weight[first]))][: max(RARE_LEAST, int(RARE_SHARE * len(kinds)))]
            place = np.flatnonzero(np.isin(w, rarest))
            postings.append((w[place], np.full(len(place), t), place, weight[place]))
        word, template, place, weight = (np.concatenate(x) for x in zip(*postings, strict=True))
        order = np.argsort(word, kind="stable")
        self.words, self.template, self.place, self.weight = word[order], template[order], place[order], weight[order]
        self.total = np.bincount(self.template, self.weight, minlength=len(words))
        self.sizes = np.array([len(w) for w in words])
        self.bands = np.maximum(BAND_LEAST, (BAND_SHARE * self.sizes).astype(np.int64))
        self.keys = [[(len(k := _hashes(p)), tk.grams(k, len(k))[0], _find(w, k)) for p in t[2]] for t, w in zip(templates, words, strict=True)]
        self.phrases = [(len(k := _hashes(p)), tk.grams(k, len(k))[0], label) for p, label in phrases.items()]

    def candidates(self, text: np.ndarray, h: np.ndarray) -> list[tuple[int, int]]:
        """(text, template) pairs whose rare words agree on three neighbouring bands of relative positions."""
        low, high = np.searchsorted(self.words, h, "left"), np.searchsorted(self.words, h, "right")
        n = high - low
        at = np.repeat(np.arange(len(h)), n)
        posting = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        template = self.template[posting]
        band = (at - self.place[posting]) // self.bands[template]
        # a vote counts for the three groups of bands that hold its own
        votes = np.concatenate([np.stack([text[at], template, band - back, posting]) for back in range(3)], axis=1)
        votes = np.unique(votes, axis=1)
        if not votes.shape[1]:
            return []
        group = np.cumsum(tk.run_starts(*votes[:3])) - 1
        share = np.bincount(group, self.weight[votes[3]]) / self.total[votes[1][tk.run_starts(*votes[:3])]]
        return sorted(set(zip(*votes[:2, (share >= AGREE - 1e-9)[group]].tolist(), strict=True)))


def _find(words: np.ndarray, key: np.ndarray) -> int:
    return next(i for i in range(len(words) - len(key) + 1) if (words[i : i + len(key)] == key).all())


def _places(text: np.ndarray, h: np.ndarray, n: int, key: np.uint64, cache: dict) -> np.ndarray:
    """Words at which the n-word phrase of hash `key` starts; `text` is the text of each word."""
    if n not in cache:
        full = np.zeros(len(h), bool)
        full[: max(0, len(h) - n + 1)] = text[n - 1 :] == text[: max(0, len(h) - n + 1)]
        cache[n] = np.where(full, tk.grams(h, n), np.uint64(0))
    return np.flatnonzero(cache[n] == key)


def _line_markers(w: tk.Words, h: np.ndarray) -> np.ndarray:
    """Mask of the words that begin a line as the line before or after it begins."""
    line = np.concatenate([[0], np.cumsum(w.bytes == 10)])[w.starts]
    first = np.flatnonzero(tk.run_starts(w.text, line)) if len(h) else np.zeros(0, np.int64)
    alike = (h[first][1:] == h[first][:-1]) & (w.text[first][1:] == w.text[first][:-1])
    out = np.zeros(len(h), bool)
    out[first[1:][alike]] = out[first[:-1][alike]] = True
    return out


def _in_order(places: list[np.ndarray], keys: list[tuple], start: int, band: int, end: int) -> bool:
    """Do the phrases after the first follow it, each after the one before and within the band?"""
    past = start + keys[0][2] + keys[0][0]
    for at, (n, _, offset) in zip(places[1:], keys[1:], strict=True):
        i = np.searchsorted(at, max(past, start + offset - band))
        if i == len(at) or at[i] > start + offset + band or at[i] + n > end:
            return False
        past = at[i] + n
    return True


def _notices(text: np.ndarray, h: np.ndarray, index: RareWordIndex, cache: dict) -> dict[tuple[int, int], float]:
    """(text, template) -> greatest weighted share of the template's rare words found in a band."""
    out: dict[tuple[int, int], float] = {}
    for x, t in index.candidates(text, h):
        keys, band, own = index.keys[t], int(index.bands[t]), index.template == t
        begin, end = int(np.searchsorted(text, x, "left")), int(np.searchsorted(text, x, "right"))
        places = [p[np.searchsorted(p, begin) : np.searchsorted(p, end)] for p in (_places(text, h, n, key, cache) for n, key, _ in keys)]
        words, place, weight = index.words[own], index.place[own], index.weight[own]
        for p in places[0].tolist():
            if out.get((x, t), 0.0) >= 1.0:
                break
            start = p - keys[0][2]
            if not _in_order(places, keys, start, band, end):
                continue
            lo = max(begin, start - band)
            near = h[lo : min(end, start + int(index.sizes[t]) + band)]
            at, posting = np.nonzero(near[:, None] == words)
            found = np.unique(posting[np.abs(at + lo - place[posting] - start) <= band])
            out[x, t] = max(out.get((x, t), 0.0), round(float(weight[found].sum() / index.total[t]), 12))
    return out


def scan_slice(column: pa.Array, index: RareWordIndex) -> dict[str, list | np.ndarray]:
    w = tk.Words(column, tk.ALNUM_WORDS, lower=True)
    h, n_texts, cache = w.hashes(), len(column), {}
    base: list[set] = [set() for _ in range(n_texts)]
    n_base, first, last = np.zeros(n_texts, np.int64), np.full(n_texts, np.iinfo(np.int64).max), np.full(n_texts, -1)
    for n, key, label in index.phrases:
        at = _places(w.text, h, n, key, cache)
        text, place = w.text[at], at - w.offsets[w.text[at]]
        np.add.at(n_base, text, 1)
        np.minimum.at(first, text, place)
        np.maximum.at(last, text, place)
        for t in np.unique(text):
            base[t].add(label)
    labels, score = [set(x) for x in base], np.where(n_base > 0, 0.5, 0.0)
    notices = [_notices(w.text, h, index, cache)]
    marker = _line_markers(w, h)
    if marker.any():
        marked = np.zeros(n_texts, bool)
        marked[w.text[marker]] = True
        kept = ~marker & marked[w.text]
        notices.append(_notices(w.text[kept], h[kept], index, {}))
    for (t, template), s in (x for found in notices for x in found.items()):
        if s >= AGREE:
            labels[t].add(index.labels[template])
            score[t] = max(score[t], min(1.0, 0.5 + 0.5 * s))
    names = lambda sets: [",".join(sorted(s)) for s in sets]
    none = n_base == 0
    return {"n_words": w.counts.astype(np.int64), "n_base": n_base, "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none), "base_labels": names(base), "labels": names(labels), "score": score}


def word_counts(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> tuple[dict[int, int], int]:
    """(texts that hold each word of the templates, by its hash; number of texts); one pass, a row a word comes back."""
    known = np.unique(np.concatenate([_hashes(t[1]) for t in templates]))

    def scan(batches):
        counts, n = np.zeros(len(known), np.int64), 0
        for b in batches:
            for i, j in tk.slices(b.column("_text")):
                w = tk.Words(b.column("_text").slice(i, j - i), tk.ALNUM_WORDS, lower=True)
                h = w.hashes()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                held = np.unique(w.text[known[at] == h] * len(known) + at[known[at] == h]) % len(known)
                counts += np.bincount(held, minlength=len(known))
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.append(tk.as_long(known), 0)), pa.array(np.append(counts, n)), pa.array(np.append(np.zeros(len(known), bool), True))], ["word", "n", "every"])

    rows = Rows(docs, text_col)
    found = rows.frame.select(rows.text).mapInArrow(scan, "word long, n long, every boolean").groupBy("word", "every").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in found if not r["every"]}, sum(r["n"] for r in found if r["every"])


def scan_licenses(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """All columns of `docs`, and n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z; a null text is
    empty.  score is 0 without any label, 0.5 for a phrase alone, and rises to 1 with the weighted
    share of a template's rare words found in its band.  Rows are judged alone but for the words'
    frequencies: ids may be of any type, be null or repeat.  Two passes, no shuffle of texts.  An
    input column with a result's name, in any case, is replaced.
    """
    index = RareWordIndex(templates, *word_counts(docs, text_col, templates))
    added = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    return with_computed(docs, text_col, ", ".join(f"{k} {v}" for k, v in added.items()), lambda texts: [pa.array(v) for v in scan_slice(texts, index).values()])
