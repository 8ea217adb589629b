"""License scan with a positional index of rare words.

The words of all templates make a small licence vocabulary; one pass over the
corpus counts in how many documents each occurs.  The index holds the positions
of each of these words in each template.  A second pass takes, of each file and
for each template that it could hold, the ``rare_words`` licence words of the
file with the highest inverse document frequency, and looks up their postings;
hits whose relative positions agree (within ``slack`` words or a third of the
template, so that a word put in or left out does no harm) are one candidate for
the template, which holds if ``min_share`` of these postings hit and every
mandatory phrase of the template stands word for word near its place.  A file
could hold a template if it has ``min_share`` of its words and all words of its
mandatory phrases.

Templates are licence names in common sentences, standard headers, titles of
full texts and SPDX tags.  Candidates of one licence that overlap are reported
once, as the longest; different licences are reported each, overlapping or not.
Whole texts are read; nothing that is sent to the driver or broadcast grows
with the corpus, only with the templates.

Defined cases: ids are integers; null and empty texts have no match; neither
have rows without a word of the index; a licence that stands in a text several
times is reported at each place; rows that are repeated are reported as often,
and rows with a null id under a null doc_id; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import isolate, table, tidy, words

RARE_WORDS = 6
SLACK = 6
MIN_SHARE = 0.6
SLICE_BYTES = 4 << 20
SCHEMA = "doc_id long, license string, word_from int, word_to int, hits int, similarity double"


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    phrases: tuple[str, ...]


TEMPLATES = (
    Template("MIT", "Released under the MIT License.", ("mit license",)),
    Template("MIT", "Licensed under the MIT License.", ("mit license",)),
    Template(
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "sublicense and or sell copies"),
    ),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    Template(
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Template(
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("terms of the gnu general public license", "version 3 of the license"),
    ),
    Template(
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ("terms of the gnu general public license", "version 2 of the license"),
    ),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu lesser general public license version 3",)),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu affero general public license version 3",)),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",)),
    Template(
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        ("redistribution and use in source and binary forms", "endorse or promote products derived"),
    ),
    Template(
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided",
        ("redistribution and use in source and binary forms", "provided with the distribution this software is provided"),
    ),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software released into the public domain",)),
    Template("CC0-1.0", "Released under CC0 1.0 Universal.", ("cc0 1 0",)),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative commons attribution noncommercial 4 0",)),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    Template(
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("unless required by applicable law or agreed to in writing", "as is basis without warranties or conditions of any kind"),
    ),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004", ("apache license version 2 0 january 2004",)),
    Template("GPL-3.0", "GNU General Public License Version 3, 29 June 2007", ("gnu general public license version 3 29 june 2007",)),
    Template("GPL-2.0", "GNU General Public License Version 2, June 1991", ("gnu general public license version 2 june 1991",)),
    Template("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007", ("gnu lesser general public license version 3 29 june 2007",)),
    Template("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007", ("gnu affero general public license version 3 19 november 2007",)),
    Template(
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ("terms of the gnu lesser general public license", "version 2 1 of the license"),
    ),
    Template(
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("terms of the gnu lesser general public license", "version 3 of the license"),
    ),
    Template(
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("terms of the gnu affero general public license", "version 3 of the license"),
    ),
    Template("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions", ("mozilla public license version 2 0 1 definitions",)),
    Template("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("copy of the mpl was not distributed with this file",)),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("terms of the eclipse public license 2 0",)),
    Template("EPL-2.0", "Eclipse Public License - v 2.0", ("eclipse public license v 2 0",)),
    Template(
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        ("provided as is without any express or implied warranty", "authors be held liable for any damages arising from the use"),
    ),
    Template("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", ("boost software license version 1 0",)),
    Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", ("boost software license version 1 0",)),
    Template("WTFPL", "Do What The Fuck You Want To Public License", ("do what the fuck you want to public license",)),
    Template("Artistic-2.0", "The Artistic License 2.0", ("artistic license 2 0",)),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike 4 0",)),
    Template("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ("creative commons attribution noderivatives 4 0",)),
    Template("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ("creative commons attribution noncommercial sharealike 4 0",)),
    *(
        Template(name, f"SPDX-License-Identifier: {name}", ("spdx license identifier " + " ".join(re.findall("[a-z0-9]+", name.lower())),))
        for name in "MIT Apache-2.0 GPL-3.0 GPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 BSD-3-Clause BSD-2-Clause ISC Unlicense CC0-1.0 CC-BY-4.0 EPL-2.0 Zlib BSL-1.0 WTFPL Artistic-2.0".split()
    ),
)


def _hashes(text: str) -> np.ndarray:
    return words([text.lower().encode()])[1]


def vocabulary(templates) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t.text) for t in templates]))


def _slices(pdf: pd.DataFrame):
    texts = [t.encode("utf-8", "replace") for t in pdf["t"]]
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b]) <= SLICE_BYTES):
            held += len(texts[b])
            b += 1
        yield a, texts[a:b]
        a = b


def _look(sorted_keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of h are keys, their places among the keys)."""
    at = np.searchsorted(sorted_keys, h)
    at[at == len(sorted_keys)] = 0
    hit = np.flatnonzero(sorted_keys[at] == h)
    return hit, at[hit]


def _counts(vocab: np.ndarray):
    def run(batches):
        df = np.zeros(len(vocab), "i8")
        for pdf in batches:
            for _, texts in _slices(pdf):
                doc, h, _, _ = words(texts)
                hit, at = _look(vocab, h)
                seen = np.unique(doc[hit] * len(vocab) + at)
                df += np.bincount(seen % len(vocab), minlength=len(vocab))
        yield pd.DataFrame({"w": np.arange(len(vocab)), "df": df})

    return run


@dataclass(frozen=True)
class Index:
    """Positions of the licence words in each template."""

    templates: tuple
    vocab: np.ndarray  # sorted hashes
    rank: np.ndarray  # of each word: its place by falling inverse document frequency
    words: np.ndarray  # words by templates: 1 where the template has the word
    musts: np.ndarray  # the same for the words of mandatory phrases
    places: tuple  # of each template: {word: positions}
    body: tuple  # of each template: its words
    phrases: tuple  # of each template: (place, words) of its mandatory phrases

    @staticmethod
    def build(templates, vocab: np.ndarray, idf: np.ndarray) -> Index:
        have, must = (np.zeros((len(vocab), len(templates)), "f4") for _ in range(2))
        rank = np.empty(len(vocab), "i8")
        rank[np.lexsort((vocab, -idf))] = np.arange(len(vocab))
        places, body, phrases = [], [], []
        for k, t in enumerate(templates):
            h = _hashes(t.text)
            at = np.searchsorted(vocab, h)
            have[at, k] = 1
            places.append({int(v): np.flatnonzero(at == v) for v in set(at.tolist())})
            body.append(h)
            own = []
            for phrase in t.phrases:
                w = _hashes(phrase)
                place = next((p for p in range(len(h) - len(w) + 1) if (h[p : p + len(w)] == w).all()), None)
                if place is None:
                    raise ValueError(f"{phrase!r} isn't in the template of {t.license}")
                must[at[place : place + len(w)], k] = 1
                own.append((place, w))
            phrases.append(tuple(own))
        return Index(tuple(templates), vocab, rank, have, must, tuple(places), tuple(body), tuple(phrases))

    def scan(self, texts: list[bytes], slack: int, min_share: float, rare_words: int = RARE_WORDS):
        """(text, template, first word, hits, similarity) of each candidate that holds."""
        doc, h, _, _ = words(texts)
        hit, at = _look(self.vocab, h)
        if not len(hit):
            return
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        mine = np.searchsorted(doc[hit], np.arange(len(texts) + 1))
        need, all_ = min_share * self.words.sum(0), self.musts.sum(0)
        for a in range(0, len(texts), 4096):  # so many rows of a dense table at a time
            lo, hi = mine[a], mine[min(len(texts), a + 4096)]
            seen = np.zeros((min(4096, len(texts) - a), len(self.vocab)), "f4")
            seen[doc[hit[lo:hi]] - a, at[lo:hi]] = 1
            for d, k in np.argwhere((seen @ self.words >= need) & (seen @ self.musts == all_)).tolist():
                own = slice(mine[a + d], mine[a + d + 1])
                yield from ((a + d, k, *found) for found in self._candidates(h, hit[own], at[own], k, int(first[a + d]), int(first[a + d + 1]), slack, min_share, rare_words))

    def _candidates(self, h, where, which, k: int, begin: int, end: int, slack: int, min_share: float, rare_words: int):
        places, body = self.places[k], self.body[k]
        rare = sorted(set(which.tolist()) & places.keys(), key=lambda v: self.rank[v])[:rare_words]
        offset, position = [], []
        for v in rare:
            w = where[which == v]
            offset.append((w[:, None] - places[v][None, :]).ravel())
            position.append(np.tile(places[v], len(w)))
        offset, position = np.concatenate(offset), np.concatenate(position)
        order = np.argsort(offset, kind="stable")
        offset, position = offset[order], position[order]
        many, loose = sum(len(places[v]) for v in rare), min(slack, max(1, len(body) // 3))
        starts = np.flatnonzero(np.concatenate([[True], np.diff(offset) > loose]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(offset)]):
            hits = len(set(position[a:b].tolist()))
            if hits < max(1, min_share * many):
                continue
            seen, votes = np.unique(offset[a:b], return_counts=True)
            # places by falling votes: the one most hits agree on, and others that they agree on as well
            for at in seen[np.lexsort((seen, -votes))][votes.max() == np.sort(votes)[::-1]].tolist():
                if all(self._near(h, w, at + place, loose, begin, end) for place, w in self.phrases[k]):
                    i, j = max(begin, at), min(end, at + len(body))
                    yield at - begin, hits, float((h[i:j] == body[i - at : j - at]).sum()) / len(body)

    @staticmethod
    def _near(h, w, at, slack, begin, end) -> bool:
        for d in sorted(range(-slack, slack + 1), key=abs):
            i = at + d
            if begin <= i and i + len(w) <= end and (h[i : i + len(w)] == w).all():
                return True
        return False


def _scan(index: Index, slack: int, min_share: float, rare_words: int):
    def run(batches):
        for pdf in batches:
            ids, out = pdf["id"].tolist(), []
            for base, texts in _slices(pdf):
                found: dict[tuple, list] = {}
                for n, k, at, hits, alike in index.scan(texts, slack, min_share, rare_words):
                    found.setdefault((n, index.templates[k].license), []).append((at, at + len(index.body[k]), hits, alike))
                for (n, name), spans in sorted(found.items()):
                    taken: list = []
                    for s in sorted(spans, key=lambda s: (s[0] - s[1], -s[3], s[0])):
                        if all(s[1] <= o[0] or s[0] >= o[1] for o in taken):
                            taken.append(s)
                    out += [(ids[base + n], name, max(0, s[0]), s[1], s[2], round(s[3], 4)) for s in sorted(taken)]
            yield pd.DataFrame(out, columns=["doc_id", "license", "word_from", "word_to", "hits", "similarity"]).astype({"doc_id": "Int64"})

    return run


def build_index(texts: DataFrame, templates=TEMPLATES) -> Index:
    """The index for a corpus (id, t), with document frequencies over all of it."""
    vocab = vocabulary(templates)
    rows = texts.mapInPandas(_counts(vocab), "w long, df long").groupBy("w").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(len(vocab))
    for r in rows:
        df[r["w"]] = r["df"]
    return Index.build(templates, vocab, -np.log1p(df))  # the order is that of the inverse document frequency


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, rare_words: int = RARE_WORDS, slack: int = SLACK, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, license, word_from, word_to, hits, similarity) of each licence found; words count from 0."""
    inner, (i, t) = isolate(docs, id_col, text_col)
    texts = inner.select(i.cast("long").alias("id"), F.lower(t.cast("string")).alias("t")).where("t is not null and t <> ''")
    return texts.mapInPandas(tidy(_scan(build_index(texts, templates), slack, min_share, rare_words)), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
