"""License scan: MinHash bands over overlapping windows, then exact containment.

Words are runs of a-z, 0-9 and non-ASCII after lower-casing; shingles have
five words.  Templates of about one length share a window: W = m + s shingles
every s, where m is the longest of them and s an eighth of it, so that any m
shingles in a row lie whole in some window.  A window and a template of which
it holds the fraction c = 0.75 are then similar to J = 0.54 or more when the
lengths agree; with ``BANDS`` bands of ``ROWS`` rows the probability that no
band agrees is (1 - J**2)**24 < 0.0003, and 0 for whole templates of one
shingle.  Candidates are verified on the words themselves: the fraction of the
template's distinct shingles found in the window and s shingles to either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import textkernel as tk
from quernstone.llm.cluster import documents, id_text

SHINGLE = 5
BANDS, ROWS = 24, 2
CONTAINMENT = 0.75

# Public license notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}

_MULT = tk.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = tk.mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _hash(k: int, shingles: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return shingles * _MULT[k] + _ADD[k]


class Templates:
    """Templates by window: ``(window, stride, names, shingle sets, MinHash values)``."""

    def __init__(self, texts: dict[str, list[str]]):
        sets = []
        for name, versions in texts.items():
            for text in versions:
                _, h = tk.words(next(tk.chunks(pa.array([text]))), lower=True, keep=tk.ALNUM_WORDS)
                sets.append((name, np.unique(tk.window_hash(h, SHINGLE)), max(1, len(h) - SHINGLE + 1)))
        sets.sort(key=lambda t: t[2])
        self.classes, group = [], []
        for t in [*sets, None]:
            if group and (t is None or 7 * t[2] > 8 * group[0][2]):
                m = group[-1][2]
                stride = max(1, m // 8)
                values = [[_hash(k, s).min() for k in range(BANDS * ROWS)] for _, s, _ in group]
                self.classes.append((m + stride if m > 1 else 1, stride, [g[0] for g in group], [g[1] for g in group], np.array(values, np.uint64)))
                group = []
            group.append(t)
        self.shingles = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t[1] for t in sets)]))


def _candidates(sh: np.ndarray, whole: np.ndarray, near: np.ndarray, window: int, stride: int, values: np.ndarray) -> set[tuple[int, int]]:
    """``(template, window number)`` of all agreements of a band.

    ``near``: where any template's shingles stand.  Values agree only where
    the least shingle is the same, so no other window can agree in a band, and
    signatures are made of the windows over those places alone.
    """
    first = np.maximum(0, -((window - 1 - near) // stride))
    w = np.unique(tk.ragged(first, near // stride - first + 1))
    at = (w * stride)[:, None] + np.arange(window)
    inside = at < len(sh)
    at = np.minimum(at, len(sh) - 1)
    inside &= whole[at]
    out: set[tuple[int, int]] = set()
    for band in range(BANDS):
        pair = [np.where(inside, _hash(band * ROWS + row, sh[at]), _LAST).min(1) for row in range(ROWS)]
        for t in range(len(values)):
            agree = np.logical_and(*(pair[row] == values[t, band * ROWS + row] for row in range(ROWS)))
            out.update((t, k) for k in w[agree].tolist())
    return out


def scan(chunk: tk.Chunk, templates: Templates) -> list[tuple[int, str, float, int, int]]:
    """``(document, name, containment, first byte, end byte)`` of each verified match; bytes within the document."""
    spans, h = tk.words(chunk, lower=True, keep=tk.ALNUM_WORDS)
    sh = tk.window_hash(h, SHINGLE)
    if not len(sh):
        return []
    doc = spans.docs()
    whole = doc[: len(sh)] == doc[SHINGLE - 1 :]
    found: dict[tuple[int, str, int], tuple[float, int, int]] = {}
    at = np.searchsorted(templates.shingles, sh)
    at[at == len(templates.shingles)] = 0
    near = np.flatnonzero(whole & (templates.shingles[at] == sh)) if len(templates.shingles) else np.zeros(0, np.int64)
    if not len(near):
        return []
    for window, stride, names, sets, values in templates.classes:
        own = near[np.isin(sh[near], np.concatenate(sets))]
        for t, w in sorted(_candidates(sh, whole, own, window, stride, values)) if len(own) else ():
            lo, hi = max(0, (w - 1) * stride), min(len(sh), (w + 1) * stride + window)
            inside = np.isin(sh[lo:hi], sets[t]) & whole[lo:hi]
            for d in np.unique(doc[lo:hi][inside]).tolist():
                at = lo + np.flatnonzero(inside & (doc[lo:hi] == d))
                share = len(np.unique(sh[at])) / len(sets[t])
                if share >= CONTAINMENT:
                    a, b = int(spans.starts[at[0]] - chunk.offs[d]), int(spans.ends[at[-1] + SHINGLE - 1] - chunk.offs[d])
                    key = (d, names[t], a)
                    found[key] = max(found.get(key, (0.0, 0, 0)), (share, a, b))
    best = []
    for d, name in sorted({(d, name) for d, name, _ in found}):
        # overlapping finds of one license are one match
        own = sorted((a, b, s) for (d2, n2, _), (s, a, b) in found.items() if (d2, n2) == (d, name))
        for a, b, s in own:
            if best and best[-1][:2] == (d, name) and a < best[-1][4]:
                best[-1] = (d, name, max(s, best[-1][2]), best[-1][3], max(b, best[-1][4]))
            else:
                best.append((d, name, s, a, b))
    return best


def _scan(texts):
    def run(batches):
        templates = Templates(texts)
        for batch in batches:
            matches: list[list] = [[] for _ in range(batch.num_rows)]
            for chunk in tk.chunks(batch.column("text")):
                for d, name, share, a, b in scan(chunk, templates):
                    matches[chunk.lo + d].append({"license": name, "containment": share, "start": a, "end": b})
            kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(matches, kind)], names=["doc_id", "matches"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, matches``; byte offsets in the text's UTF-8.

    Null, empty and short texts match nothing; null ids and repeated rows are
    scanned like others; a match with several licenses is listed under each;
    no templates, no matches.  Templates of fewer words than a shingle are
    refused.  Other columns are not looked at.  No shuffle.
    """
    texts = TEMPLATES if templates is None else templates
    for name, versions in texts.items():
        for text in versions:
            if len(tk.words(next(tk.chunks(pa.array([text]))), lower=True, keep=tk.ALNUM_WORDS)[1]) < SHINGLE:
                raise ValueError(f"template of {name} has fewer than {SHINGLE} words")
    return id_text(docs, id_col, text_col).mapInArrow(_scan(texts), "doc_id long, matches array<struct<license: string, containment: double, start: bigint, end: bigint>>")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"), F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("best"))
