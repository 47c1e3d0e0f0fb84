"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

The whole text, every line of it and every window of a template's number of words, at each word and across lines, are candidates.  A candidate of ``a`` bigrams can reach ``threshold`` only against a
template of ``b`` bigrams with ``threshold / (2 - threshold) <= a / b <= (2 - threshold) / threshold``; these bounds
leave out nearly all texts and lines before any bigram is compared.  Windows are compared all at once: an occurrence of a
bigram counts in the windows that hold it and fewer than the template's number of it before it, so differences at the ends
of these windows add up to what each window shares.  Of windows in a row that match, the best stands for all.  Bigrams
count as often as they occur.

Defined cases: a null or blank text has no match (null licence, score 0); ties go to the template that sorts first, then
the earliest place; repeated rows are judged each by itself; matches that overlap
are one place; extra columns are ignored.
"""

from __future__ import annotations

import pkgutil
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import ALNUM, LOWER, U64, SpanHash, flat, map_chunks, mix, spans

THRESHOLD = 0.8

# Notices by which works are put under a licence, in common wordings.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This software is licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Licences whose full text is a template too (files of ``licence_texts``).
FULL = ["Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"]
for _name in FULL:
    TEMPLATES[_name].append(pkgutil.get_data(__package__, f"licence_texts/{_name}.txt").decode())

MATCHES = "doc_id long, license string, score double, start long, end long, n_matches long, licenses array<string>"


def _bigrams(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * U64(0x9FB21C651E98DF25) + h[1:]) if len(h) > 1 else np.zeros(0, U64)


class Templates:
    """Sorted bigrams (with counts) of each template."""

    def __init__(self, texts: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold, self.names, self.parts = threshold, [], []
        for name in sorted(texts):
            for text in texts[name]:
                buf, offs = flat(pa.array([text]))
                low = LOWER[buf]
                self.names.append(name)
                self.parts.append(np.unique(_bigrams(SpanHash(low)(*spans(ALNUM[low], offs))), return_counts=True))
        self.sizes = np.array([c.sum() for _, c in self.parts])
        self.low, self.high = self.sizes * threshold / (2 - threshold), self.sizes * (2 - threshold) / threshold
        self.any = np.unique(np.concatenate([g for g, _ in self.parts])) if self.parts else np.zeros(0, U64)
        self.counts = np.zeros((len(self.parts), len(self.any)), np.int32)  # how often each template has each bigram
        for t, (g, c) in enumerate(self.parts):
            self.counts[t, np.searchsorted(self.any, g)] = c


def dice(a: tuple, b: tuple) -> float:
    """2 * shared / (all of both), with multiplicity."""
    both, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    total = a[1].sum() + b[1].sum()
    return float(2 * np.minimum(a[1][x], b[1][y]).sum() / total) if total else 0.0


def _slide(place, gram, own: Templates, t: int, n: int) -> np.ndarray | None:
    """What the window of a template's size shares with it from each of ``n`` bigrams on, or None if none can match."""
    size, count = int(own.sizes[t]), own.counts[t][gram]
    ok = count > 0
    place, gram, count = place[ok], gram[ok], count[ok]
    need = max(1, int(np.ceil(own.threshold * size - 1e-9)))
    if len(place) < need or (place[need - 1 :] - place[: len(place) - need + 1]).min() >= size:
        return None
    order = np.argsort(gram, kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    before = at - count  # the occurrence that fills the template's number
    same = (before >= 0) & (gram[order[np.maximum(before, 0)]] == gram)
    begin = np.maximum(place - size + 1, np.where(same, place[order[np.maximum(before, 0)]] + 1, 0))
    edges = np.bincount(np.maximum(begin, 0), minlength=n + 1) - np.bincount(place + 1, minlength=n + 1)
    return np.cumsum(edges)[:n]


def _places(spans: list) -> int:
    """How many runs of overlapping spans there are."""
    n, last = 0, -1
    for a, b in sorted(spans):
        n, last = n + (a >= last), max(last, b)
    return n


def _scan(batch, buf, offs, own: Templates):
    low = LOWER[buf]
    starts, ends = spans(ALNUM[low], offs)
    h = SpanHash(low)(starts, ends)
    n = len(offs) - 1
    pairs = _bigrams(h)
    known = np.zeros(len(pairs) + 1, np.int64)
    if len(pairs) and len(own.any):
        at = np.minimum(np.searchsorted(own.any, pairs), len(own.any) - 1)
        held = own.any[at] == pairs
        known[1:] = np.cumsum(held)
        place, gram = np.flatnonzero(held), at[held]
    breaks = np.flatnonzero(buf == 10)
    begin = np.concatenate([np.sort(np.concatenate([offs[:-1], breaks + 1])), offs[:-1]])
    stop = np.concatenate([np.sort(np.concatenate([breaks, offs[1:]])), offs[1:]])
    doc = np.concatenate([np.searchsorted(offs, begin[: len(begin) - n], "right") - 1, np.arange(n)])
    a, b = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    size = np.maximum(b - a - 1, 0)
    # size bounds over all templates, and at least half a threshold's worth of bigrams that some template has
    fits = (size >= own.low.min()) & (size <= own.high.max()) & (size > 0)
    fits &= 2 * (known[np.maximum(b - 1, 0)] - known[np.minimum(a, len(known) - 1)]) >= own.threshold * size
    found = [[] for _ in range(n)]
    seen = set()
    for i in np.flatnonzero(fits).tolist():
        if (begin[i], stop[i]) in seen:
            continue  # a text of one line
        seen.add((begin[i], stop[i]))
        grams = np.unique(pairs[a[i] : b[i] - 1], return_counts=True)
        for t in np.flatnonzero((own.low <= size[i]) & (size[i] <= own.high)).tolist():
            score = dice(grams, own.parts[t])
            if score >= own.threshold:
                found[doc[i]].append((-round(score, 6), own.names[t], int(begin[i] - offs[doc[i]]), int(stop[i] - offs[doc[i]])))
    word_offs = np.searchsorted(starts, offs)
    for t in range(len(own.parts)) if len(pairs) and len(own.any) else ():
        size = int(own.sizes[t])
        shared = _slide(place, gram, own, t, len(pairs)) if size else None
        if shared is None:
            continue
        s = np.flatnonzero(shared / size >= own.threshold)
        of = np.searchsorted(word_offs, s, "right") - 1
        ok = s + size < word_offs[of + 1]
        s, of = s[ok], of[ok]
        for run in np.split(np.arange(len(s)), np.flatnonzero((np.diff(s) > 1) | (np.diff(of) > 0)) + 1) if len(s) else ():
            i = run[shared[s[run]].argmax()]
            d = of[i]
            found[d].append((-round(float(shared[s[i]] / size), 6), own.names[t], int(starts[s[i]] - offs[d]), int(ends[s[i] + size] - offs[d])))
    best = [min(x) if x else None for x in found]
    return {
        "doc_id": batch.column("doc_id"), "license": pa.array([x and x[1] for x in best], pa.string()), "score": pa.array([-x[0] if x else 0.0 for x in best]), "start": pa.array([x and x[2] for x in best], pa.int64()),
        "end": pa.array([x and x[3] for x in best], pa.int64()), "n_matches": pa.array([_places([m[2:] for m in x]) for x in found], pa.int64()), "licenses": pa.array([sorted({m[1] for m in x}) for x in found], pa.list_(pa.string())),
    }


def scan(docs: DataFrame, texts: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Each document's best licence with score and place (bytes), how many places match, and all licences found."""
    return map_chunks(docs.select("doc_id", "text"), _scan, MATCHES, setup=lambda: Templates(texts, threshold))


def brute(text: str | None, texts: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
    """The same for one text in plain Python, for tests: (licence, score, licences)."""
    from collections import Counter

    def grams(x):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in x))
        return list(zip(w, w[1:]))

    hits, whole = [], grams(text or "")
    parts = [Counter(grams(x)) for x in [text or "", *(text or "").split("\n")]]
    for name in sorted(texts):
        for k in (Counter(grams(t)) for t in texts[name]):
            size = sum(k.values())
            scores = [2 * sum((g & k).values()) / (sum(g.values()) + size) for g in parts if g]
            now, shared = Counter(), 0
            for i, g in enumerate(whole):
                now[g] += 1
                shared += now[g] <= k[g]
                if i >= size:
                    shared -= now[whole[i - size]] <= k[whole[i - size]]
                    now[whole[i - size]] -= 1
                if i >= size - 1:
                    scores.append(shared / size)
            hits += [(-round(x, 6), name) for x in scores if x >= threshold]
    return (min(hits)[1], -min(hits)[0], sorted({n for _, n in hits})) if hits else (None, 0.0, [])
