"""Licences of files: notices by TF-IDF cosine to templates, the rest from the nearest directory above.

Stretches of every text are compared with every template as sparse vectors of
term counts times inverse document frequency. Document frequencies are counted
over all documents for the templates' terms; any other word is as rare as can
be, and words of marks only, as those that begin a comment, count for nothing.
Lines, sentences and, across lines, all windows of a notice's length are
compared with the notices; windows of the length of a licence's text or
standard header, and texts that are shorter as a whole, are compared with that.
A stretch at least ``LIKE`` alike is a notice. A file that is mostly notices is
a licence file and holds for its directory and those below, up to the next
licence file; a notice of a file's own comes first.

Stretches that cannot be ``LIKE`` alike are passed over by a bound that loses
none: the cosine is at most the root of the template's share of squared weight
that lies on terms which the stretch has.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, _OF_BYTE, LOWER, Texts, cut, slices, small

#: Names of licences by identifier, and the forms of a notice.
NAMES = {
    "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "Apache-2.0": "the Apache License, Version 2.0",
    "BSD-2-Clause": "the BSD 2-Clause License",
    "BSD-3-Clause": "the BSD 3-Clause License",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-ND-4.0": "CC BY-ND 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC0-1.0": "CC0 1.0",
    "GPL-2.0": "the GNU General Public License, version 2",
    "GPL-3.0": "the GNU General Public License, version 3",
    "ISC": "the ISC License",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3",
    "MIT": "the MIT License",
    "MPL-2.0": "the Mozilla Public License, version 2.0",
    "Unlicense": "the Unlicense",
}
FORMS = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This program is free software, licensed under {}.", "Distributed under the terms of {}.")
#: Identifiers in SPDX tags, where they are more than the licence's own.
SPDX = {k: (k, f"{k}-only", f"{k}-or-later") for k in NAMES if "GPL" in k}
#: Notices by identifier.
TEMPLATES = {k: (*(form.format(name) for form in FORMS), *(f"SPDX-License-Identifier: {x}" for x in SPDX.get(k, (k,)))) for k, name in NAMES.items()} | {
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved."),
    "Public-Domain": ("This work is in the public domain.", "Dedicated to the public domain."),
}
_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {v} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
#: Standard headers of source files.
HEADERS = {
    "AGPL-3.0": _GNU.format(what="program", name="Affero General Public License", v=3),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0": _GNU.format(what="program", name="General Public License", v=2),
    "GPL-3.0": _GNU.format(what="program", name="General Public License", v=3),
    "LGPL-2.1": _GNU.format(what="library", name="Lesser General Public License", v=2.1),
    "LGPL-3.0": _GNU.format(what="library", name="Lesser General Public License", v=3),
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
#: A text that is not held is made of a sibling's by replacing words.
SIBLINGS = {
    "AGPL-3.0": ("GPL-3.0", (("GNU GENERAL", "GNU AFFERO GENERAL"), ("GNU General", "GNU Affero General"))),
    "CC-BY-4.0": ("CC-BY-SA-4.0", (("Attribution-ShareAlike", "Attribution"), ("BY-SA", "BY"), ("ShareAlike", ""))),
    "CC-BY-NC-4.0": ("CC-BY-SA-4.0", (("Attribution-ShareAlike", "Attribution-NonCommercial"), ("BY-SA", "BY-NC"), ("ShareAlike", "NonCommercial"))),
    "CC-BY-ND-4.0": ("CC-BY-SA-4.0", (("Attribution-ShareAlike", "Attribution-NoDerivatives"), ("BY-SA", "BY-ND"), ("ShareAlike", "NoDerivatives"))),
}
#: Least cosine of a notice, and the least share of words in notices of a licence file.
LIKE, MOSTLY = 0.8, 0.5

_MARK = np.isin(np.arange(256), list(b"\"'()*,.:;<>[]{}!?#/-_=+|&%$"))


def licence_texts() -> dict[str, tuple[str, ...]]:
    """Whole texts and standard headers by identifier; read on the driver."""
    folder = resources.files(__package__) / "licence_texts"
    out = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    for name, (sibling, changes) in SIBLINGS.items():
        text = out[sibling]
        for old, new in changes:
            text = text.replace(old, new)
        out[name] = text
    return {k: tuple(x[k] for x in (out, HEADERS) if k in x) for k in sorted(out.keys() | HEADERS.keys())}


def _terms(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's words in lower case without marks at their ends, and which words are more than marks."""
    starts, ends = t.starts.copy(), t.ends.copy()
    for edge, step in ((starts, 1), (ends, -1)):
        while True:
            at = edge if step > 0 else edge - 1
            loose = (starts + 1 < ends) & _MARK[t.data[np.minimum(at, len(t.data) - 1)]] if len(starts) else np.zeros(0, bool)
            if not loose.any():
                break
            edge[loose] += step
    solid = (starts + 1 < ends) | ~_MARK[t.data[starts]] if len(starts) else np.zeros(0, bool)
    return _BYTES[0].stretches(_OF_BYTE[0][LOWER[t.data]], starts, ends), solid


def _of(text: str) -> Texts:
    data = np.frombuffer(text.encode(), np.uint8)
    return Texts(0, data, np.array([0, len(data)]))


def _solid_terms(text: str) -> np.ndarray:
    hashes, solid = _terms(_of(text))
    return hashes[solid]


class Templates:
    """Notices and licence texts as vectors over their terms, in the order of the terms' hashes."""

    def __init__(self, templates: dict[str, tuple[str, ...]], texts: dict[str, tuple[str, ...]] | None = None) -> None:
        every = [(name, text) for x in (templates, texts or {}) for name in sorted(x) for text in x[name]]
        self.names = [name for name, _ in every]
        self.notices = sum(map(len, templates.values()))
        words = [_solid_terms(text) for _, text in every]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.terms = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.counts = np.stack([np.bincount(np.searchsorted(self.terms, w), minlength=len(self.terms)) for w in words]) if words else np.zeros((0, 0))

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's term, or the number of terms where it is none."""
        n = len(self.terms)
        at = np.minimum(np.searchsorted(self.terms, hashes), max(0, n - 1))
        return np.where(self.terms[at] == hashes, at, n) if n else np.zeros(len(hashes), np.int64)

    def weights(self, frequency: dict[int, int], documents: int) -> np.ndarray:
        """Inverse document frequency of each term, and last that of any other word."""
        df = np.array([frequency.get(i, 0) for i in range(len(self.terms))] + [0], float)
        return np.log((1 + documents) / (1 + df)) + 1


def frequencies(docs: DataFrame, templates: Templates, *, text: str = "text") -> tuple[dict[int, int], int]:
    """In how many documents each of the templates' terms is, and the number of all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.zeros(len(templates.terms) + 1, np.int64)
            for t in slices(b["text"]):
                term = templates.place(_terms(t)[0])
                doc = np.repeat(np.arange(len(t)), np.diff(t.at))
                known = term < len(templates.terms)
                pair = np.unique(doc[known] * len(sums) + term[known])
                sums += np.bincount(pair % len(sums), minlength=len(sums))
                sums[-1] += len(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)).astype(np.int32)), pa.array(sums)], ["term", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term
    found = {r["term"]: r["n"] for r in rows}
    return found, found.pop(len(templates.terms), 0)


class Words:
    """The words of a slice that are more than marks: their terms and texts, and where lines and sentences end."""

    def __init__(self, t: Texts, templates: Templates) -> None:
        hashes, solid = _terms(t)
        self.texts = len(t)
        self.doc = np.repeat(np.arange(len(t)), np.diff(t.at))[solid]
        self.term = templates.place(hashes)[solid]
        self.at = np.searchsorted(self.doc, np.arange(len(t) + 1))
        line = np.cumsum(t.data == 10)[t.starts]
        stop = np.isin(t.data[t.ends - 1], list(b".!?")) if len(t.ends) else np.zeros(0, bool)
        sentence = np.cumsum(np.r_[False, stop[:-1]]) if len(stop) else np.zeros(0, np.int64)
        self.line, self.sentence = line[solid], sentence[solid]

    def stretches(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, end) of each run of words of one text with one number."""
        if not len(number):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (self.doc[1:] != self.doc[:-1])])
        return first, np.r_[first[1:], len(number)]


class Likeness:
    """Templates scaled by the terms' weights."""

    def __init__(self, templates: Templates, weight: np.ndarray) -> None:
        self.templates, self.weight = templates, weight
        vectors = templates.counts * weight[:-1]
        vectors = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True)) if len(vectors) else np.zeros((0, len(weight) - 1))
        self.vectors = np.concatenate([vectors, np.zeros((len(vectors), 1))], 1)  # no template has any other word
        self.squares = self.vectors**2
        # a stretch with none of a notice's anchors has less of its squared weight than LIKE takes
        self.anchors = np.zeros((templates.notices, len(weight)), bool)
        for k, x in enumerate(self.squares[: templates.notices]):
            order = np.argsort(-x, kind="stable")
            rest = x.sum() - np.r_[0, np.cumsum(x[order])]
            self.anchors[k, order[: int(np.argmax(rest < LIKE * LIKE - 1e-6))]] = True
        self.any_anchor = self.anchors.any(0)

    def cosines(self, term: np.ndarray, first: np.ndarray, end: np.ndarray, which: slice | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(cosines by template and stretch, the stretches' numbers), so many stretches at a time that memory stays bounded."""
        at, total = 0, np.r_[0, np.cumsum(end - first)]
        vectors = self.vectors[which]
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(total, total[at] + 200_000, "right")) - 1)
            a, n = first[at:to], (end - first)[at:to]
            stretch = np.repeat(np.arange(to - at), n)
            words = term[np.repeat(a - (total[at:to] - total[at]), n) + np.arange(n.sum())]
            known = words < len(self.weight) - 1
            size = np.bincount(stretch[~known], minlength=to - at) * self.weight[-1] ** 2  # every other word is a term of its own
            pair, count = np.unique(stretch[known] * len(self.weight) + words[known], return_counts=True)
            row, column = np.divmod(pair, len(self.weight))
            value = count * self.weight[column]
            size += np.bincount(row, value * value, minlength=to - at)
            dots = np.stack([np.bincount(row, value * v[column], minlength=to - at) for v in vectors])
            yield np.round(dots / np.sqrt(size), 9), np.arange(at, to)
            at = to


class Found:
    """The best template of each text, and which words are in notices."""

    def __init__(self, words: Words, names: list[str]) -> None:
        self.words, self.names = words, names
        self.best, self.score = np.full(words.texts, -1), np.zeros(words.texts)
        self.rank = [(-1, 0.0, 0)] * words.texts
        self.steps = np.zeros(len(words.term) + 1, np.int64)

    def add(self, first: np.ndarray, end: np.ndarray, which: np.ndarray, cosine: np.ndarray, text: bool) -> None:
        """Of a text's matches licence texts and headers come first, then notices that name a licence; then the more alike, then the first."""
        np.add.at(self.steps, first, 1)
        np.add.at(self.steps, end, -1)
        for a, k, like in zip(first.tolist(), which.tolist(), cosine.tolist(), strict=True):
            d = self.words.doc[a]
            rank = (2 if text else int(self.names[k] != "Proprietary"), like, -a)
            if rank > self.rank[d]:
                self.rank[d], self.best[d], self.score[d] = rank, k, like

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        inside = np.bincount(self.words.doc, np.cumsum(self.steps)[:-1] > 0, minlength=self.words.texts).astype(np.int64)
        return self.best, self.score, inside, np.diff(self.words.at)


def _stretches(w: Words, like: Likeness, number: np.ndarray, found: Found) -> None:
    first, end = w.stretches(number)
    hot = np.r_[0, np.cumsum(like.any_anchor[w.term])]
    near = hot[end] > hot[first]
    first, end = first[near], end[near]
    for cosine, which in like.cosines(w.term, first, end, slice(0, like.templates.notices)):
        top = cosine.argmax(0)
        value = cosine[top, np.arange(len(which))]
        good = value >= LIKE
        found.add(first[which[good]], end[which[good]], top[good], value[good], False)


def _windows(w: Words, like: Likeness, found: Found) -> None:
    """All windows of each notice's length that have one of its anchors, across lines."""
    lengths = like.templates.lengths[: like.templates.notices]
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        place = np.flatnonzero(like.anchors[same].any(0)[w.term])
        first = np.unique((place[:, None] - np.arange(n)).ravel())
        first = first[first >= 0]
        first = first[first + n <= w.at[w.doc[first] + 1]]
        for cosine, which in like.cosines(w.term, first, first + n, same):
            top = cosine.argmax(0)
            value = cosine[top, np.arange(len(which))]
            good = value >= LIKE
            found.add(first[which[good]], first[which[good]] + n, same[top[good]], value[good], False)


def _licence_texts(w: Words, like: Likeness, found: Found) -> None:
    """Windows of each licence text's length, a sixteenth of it apart, in texts that have enough of its squared weight; shorter texts as a whole."""
    known = w.term < len(like.weight) - 1
    pair = np.unique(w.doc[known] * len(like.weight) + w.term[known])
    doc, term = np.divmod(pair, len(like.weight))
    for k in range(like.templates.notices, len(like.templates.names)):
        has = np.bincount(doc, like.squares[k][term], minlength=w.texts)
        n = int(like.templates.lengths[k])
        for d in np.flatnonzero(has >= LIKE * LIKE - 1e-6).tolist():
            a, b = int(w.at[d]), int(w.at[d + 1])
            first = np.unique(np.r_[np.arange(a, max(a, b - n) + 1, max(1, n // 16)), max(a, b - n)])
            end = np.minimum(first + n, b)
            for cosine, which in like.cosines(w.term, first, end, np.array([k])):
                good = cosine[0] >= LIKE
                found.add(first[which[good]], end[which[good]], np.full(int(good.sum()), k), cosine[0][good], True)


def notices(t: Texts, templates: Templates, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(best template or -1, its cosine, words in notices, words) of each text of a slice, of whole lines alone."""
    w, like = Words(t, templates), Likeness(templates, weight)
    found = Found(w, templates.names)
    if templates.notices:
        _stretches(w, like, w.line, found)
    return found.result()


def matches(t: Texts, like: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, of lines, sentences and windows, and of licence texts."""
    w = Words(t, like.templates)
    found = Found(w, like.templates.names)
    if like.templates.notices:
        _stretches(w, like, w.line, found)
        _stretches(w, like, w.sentence, found)
        _windows(w, like, found)
    _licence_texts(w, like, found)
    return found.result()


def scan(docs: DataFrame, path: Column, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, path, own_license, similarity, license_file), in two passes without a shuffle of texts.

    Null and empty texts have no notice, long ones are scanned whole, repeated
    rows get equal results, no rows give no rows. Licence texts and headers come before
    notices, and notices that name a licence before reserved rights; of equally
    alike ones the first counts, of templates the first by name. ``texts`` are
    ``licence_texts()`` unless given. Other columns are not read.
    """
    known = Templates(templates, licence_texts() if texts is None else texts)
    weight = known.weights(*frequencies(docs, known, text=text))
    chosen = docs.select(F.col(doc_id).alias("doc_id"), path.alias("path"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        like = Likeness(known, weight)
        for b in batches:
            for t in slices(b["text"]):
                best, score, inside, words = matches(t, like)
                names = pa.array([known.names[k] if k >= 0 else None for k in best.tolist()], pa.string())
                part = b.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["path"], names, pa.array(np.round(score, 6)), pa.array((words > 0) & (inside >= MOSTLY * words))], ["doc_id", "path", "own_license", "similarity", "license_file"])

    return chosen.mapInArrow(run, f"doc_id {kind}, path string, own_license string, similarity double, license_file boolean")


def inherit(scanned: DataFrame) -> DataFrame:
    """The scanned files with ``license`` and ``license_dir``: their own, or that of the nearest directory above.

    Directories, not files, are joined with those above them, and only those
    with a licence above come back to the files, by broadcast where they are
    few: a directory with a third of all files counts once. Of several licence
    files in a directory the first by path holds, of several rows of it the
    first licence by name. Repeated rows get equal results. A null path has no
    directory; no rows give no rows.
    """
    files = cut(scanned.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)))
    holds = files.where("license_file AND own_license IS NOT NULL AND path IS NOT NULL").groupBy("dir").agg(F.min(F.struct("path", "own_license")).alias("m")).select(F.col("dir").alias("above"), F.col("m.own_license").alias("dir_license"))
    dirs = files.where("path IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("above"))
    nearest = cut(above.join(holds, "above").groupBy("dir").agg(F.max_by(F.struct("above", "dir_license"), F.length("above")).alias("m")).select("dir", F.col("m.above").alias("license_dir"), "m.dir_license"))
    out = files.join(small(nearest, nearest.count()), "dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select("doc_id", "path", "own_license", "similarity", "license_file", F.coalesce("own_license", "dir_license").alias("license"), F.when(~own, F.col("license_dir")).alias("license_dir"))
