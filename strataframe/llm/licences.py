"""Licence scan by a positional index of rare template words.

Templates are short notices and the whole texts or grants of common licences. Every template word has an inverse document
frequency over the templates; the rare ones (the highest-IDF words) are indexed as word -> postings (label, template,
position). A file's own rare licence words are looked up, and postings vote for the places where a template may begin
(position in the file less position in the template). A label is given only if at such a place words with ``LEAST_SHARE`` of
the whole template's IDF stand where they should, within a tolerance, and, besides, one of its mandatory key phrases stands
in the file close by. Base phrases give their labels wherever their words stand consecutively.

A null or empty text has no words, no labels and score 0. Words are runs of ASCII letters and digits and of non-ASCII code
points, A-Z lower-cased. Texts of any length are scanned whole. Repeated rows give repeated results, a null id one too; only
doc_id and text are read, so other columns, whatever their names, change nothing. An empty table gives no rows. No shuffle.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alnum_words, map_texts

# Base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, notice, mandatory key phrases (one of them has to be there).
TEMPLATES = [
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge to any person obtaining",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl-2.0", "this program is free software licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", "released under the bsd license", ("bsd license", "clause bsd")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("public-domain", "released into the public domain", ("public domain",)),
    ("cc0", "to the extent possible under law the author has waived all copyright cc0 1 0", ("cc0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc", "creative commons attribution noncommercial")),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa", "creative commons attribution sharealike")),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("attribution 4", "attribution 3", "attribution international", "attribution license")),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the software""", ("subject to the following conditions the above copyright notice",)),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary
        form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
        provided with the distribution""", ("redistributions in binary form must reproduce the above copyright notice",)),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain
        a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under
        the license is distributed on an as is basis without warranties or conditions of any kind either express or implied""", ("except in compliance with the license",)),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
        software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful
        but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose""", ("gnu general public license as published by the free software foundation",)),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you
        can obtain one at https mozilla org mpl 2 0""", ("mozilla public license v 2 0",)),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from
        the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
        redistribute it freely""", ("to alter it and redistribute it freely",)),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute
        this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""", ("unencumbered software released into the public domain",)),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies""", ("this permission notice appear in all copies",)),
    ("proprietary", "confidential and proprietary unauthorized copying of this file is strictly prohibited", ("confidential and proprietary", "unauthorized copying")),
]

#: Words in at most this many templates are indexed.
MAX_TEMPLATES = 4
#: How far apart votes may be, in words, and how far from the template a key phrase may stand.
TOLERANCE = 3
#: Share of a template's IDF, over all its words, that has to agree on a place: more than a mention of its name has.
LEAST_SHARE = 0.75


class Template:
    """A template's words with their positions, and their weights."""

    def __init__(self, words: list[bytes], weight: dict[bytes, float]):
        self.length = len(words)
        self.positions: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            self.positions[w].append(p)
        self.weight = {w: weight[w] for w in self.positions}
        self.total = sum(self.weight.values())

    def share(self, words: list[bytes], begin: int) -> float:
        """Share of the weight of the words that stand in a file where they should if the template begins at ``begin``, or up
        to ``TOLERANCE`` words behind."""
        agreed = set()
        for i in range(max(begin, 0), min(begin + self.length + TOLERANCE, len(words))):
            if any(begin <= i - p <= begin + TOLERANCE for p in self.positions.get(words[i], ())):
                agreed.add(words[i])
        return sum(map(self.weight.__getitem__, sorted(agreed))) / self.total


@lru_cache(1)
def index() -> tuple[dict[bytes, list[tuple[int, int]]], list[Template]]:
    """Postings of rare words, and the templates."""
    words = [t.encode().split() for _, t, _ in TEMPLATES]
    df = Counter(w for ws in words for w in set(ws))
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for k, ws in enumerate(words):
        for p, w in enumerate(ws):
            if df[w] <= MAX_TEMPLATES:
                postings[w].append((k, p))
    idf = {w: math.log(1 + len(words) / n) for w, n in df.items()}
    return dict(postings), [Template(ws, idf) for ws in words]


def places(joined: bytes, phrase: str) -> list[int]:
    """Word numbers where a phrase starts in `` w0 w1 ... ``."""
    needle, out, at, seen, last = f" {phrase} ".encode(), [], joined.find(f" {phrase} ".encode()), 0, 0
    while at >= 0:
        seen += joined.count(b" ", last, at)
        last = at
        out.append(seen)
        at = joined.find(needle, at + 1)
    return out


def method_labels(words: list[bytes], joined: bytes) -> dict[str, float]:
    """Labels that the index finds and key phrases confirm, with the share of the template's IDF that agreed."""
    postings, templates = index()
    if postings.keys().isdisjoint(words):
        return {}
    votes: dict[int, set[int]] = defaultdict(set)
    for i, w in enumerate(words):
        for k, p in postings.get(w, ()):
            votes[k].add(i - p)
    found: dict[str, float] = {}
    for k, starts in votes.items():
        label, _, keys = TEMPLATES[k]
        confirmed = np.array(sorted({x for key in keys for x in places(joined, key)}))
        if not len(confirmed):
            continue
        begins = np.array(sorted(starts))
        near = np.searchsorted(confirmed, begins - TOLERANCE)
        close = (near < len(confirmed)) & (confirmed[np.minimum(near, len(confirmed) - 1)] <= begins + templates[k].length + TOLERANCE)
        share = max((templates[k].share(words, a) for a in begins[close].tolist()), default=0.0)
        if share >= LEAST_SHARE:
            found[label] = max(found.get(label, 0.0), min(1.0, share))
    return found


def scan_texts(texts: list[bytes]) -> dict[str, object]:
    cols: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
    for text in texts:
        words = alnum_words(text)
        joined = b" " + b" ".join(words) + b" "
        base = {label: found for phrase, label in BASE_PHRASES.items() if (found := places(joined, phrase))}
        more = method_labels(words, joined)
        starts = [x for found in base.values() for x in found]
        cols["n_words"].append(len(words))
        cols["n_base"].append(len(starts))
        cols["first_word"].append(min(starts, default=None))
        cols["last_word"].append(max(starts, default=None))
        cols["base_labels"].append(",".join(sorted(base)))
        cols["labels"].append(",".join(sorted({*base, *more})))
        cols["score"].append(1.0 if base else max(more.values(), default=0.0))
    kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
    return {c: pa.array(v, kind) for (c, v), kind in zip(cols.items(), kinds)}


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    (1 with a base phrase, else the best label's share of its template's IDF)."""
    return map_texts(
        docs.select("doc_id", "text"), scan_texts,
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
