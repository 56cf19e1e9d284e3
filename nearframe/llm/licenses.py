"""License scans: normalised text against licence templates by the Dice coefficient of word bigrams.

Units of a text are its lines, its paragraphs (between blank lines) and the whole. A unit is lowered, every
run of other characters than a-z and 0-9 becomes one blank, and its distinct bigrams are compared with a
template's if the sizes allow the threshold t: a coefficient of t needs a size between t/(2-t) and (2-t)/t of
the template's. A licence within longer text is found by windows: every run of as many bigrams as the template
has, anywhere in the text. Both need t/(2-t) of a template's distinct bigrams in the text, so only templates
of which a text has that many are compared. Templates are a fixed list, part of the plan; no row leaves its task.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearframe.llm.common import add_columns, free_name, prepare

THRESHOLD = 0.8
# Texts of licence notices.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}


# Notices of further versions; the canonical texts of whole licences are the files of license_texts.
NOTICES: dict[str, list[str]] = {
    "GPL-1.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 1.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "LGPL-2.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Library General Public License, version 2.",
        "This work is licensed under the GNU Lesser General Public License, version 2.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
}
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
WORD = re.compile("[a-z0-9]+")
#: Keys of bigrams: the first word's number times this, plus the second's.
WIDE = 1 << 31


def all_templates() -> dict[str, list[str]]:
    """TEMPLATES, NOTICES and the whole licences."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for name, texts in NOTICES.items():
        out.setdefault(name, []).extend(texts)
    for file in sorted(os.listdir(TEXTS)):
        if file.endswith(".txt"):
            with open(os.path.join(TEXTS, file), encoding="utf-8") as f:
                out.setdefault(file[:-4], []).append(f.read())
    return out


def bigrams(text: str) -> list[str]:
    """Distinct bigrams of a normalised text, sorted."""
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})


@dataclass(frozen=True)
class Index:
    names: list[str]
    fixed: list[bool]  # not one of those that are added to TEMPLATES
    grams: list[frozenset[int]]  # distinct keys of each template
    lengths: list[int]  # bigrams with repeats
    vocabulary: dict[str, int]
    keys: np.ndarray  # all templates' keys, sorted
    has: np.ndarray  # (templates, keys) bool


def index(templates: dict[str, list[str]], added: frozenset[str] = frozenset()) -> Index:
    """Templates by the keys of their bigrams; those of fewer than two words are left out. added: texts beyond TEMPLATES."""
    vocabulary: dict[str, int] = {}
    names, fixed, grams, lengths = [], [], [], []
    for name, text in ((n, t) for n, ts in sorted(templates.items()) for t in ts):
        w = [vocabulary.setdefault(x, len(vocabulary)) for x in WORD.findall(text.lower())]
        if len(w) > 1:
            names.append(name)
            fixed.append(text not in added)
            grams.append(frozenset(a * WIDE + b for a, b in zip(w[:-1], w[1:], strict=True)))
            lengths.append(len(w) - 1)
    keys = np.array(sorted(frozenset().union(*grams)), np.int64)
    has = np.array([np.isin(keys, np.array(sorted(g), np.int64)) for g in grams], bool).reshape(len(grams), len(keys))
    return Index(names, fixed, grams, lengths, vocabulary, keys, has)


def standard() -> Index:
    texts = all_templates()
    return index(texts, frozenset(t for n, ts in texts.items() for t in ts if t not in TEMPLATES.get(n, [])))


def units(text: str) -> set[str]:
    """Distinct lines, paragraphs and the whole text."""
    return {*text.split("\n"), *re.split("\n[ \t\r]*\n", text), text}


def _distinct(prev: np.ndarray, at: np.ndarray, m: int, n: int) -> np.ndarray:
    """How many different keys each window of m places has, counting places `at` only; prev: a key's place before."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.maximum(np.maximum(prev[at] + 1, at - m + 1), 0), 1)
    np.add.at(steps, at + 1, -1)
    return np.cumsum(steps)[: n - m + 1]


def match(text: str, ix: Index, threshold: float = THRESHOLD) -> tuple[str | None, float, int]:
    """(license, dice, n_matches) of one text."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    words = WORD.findall(text.lower())
    if len(words) < 2 or not len(ix.keys):
        return None, 0.0, 0
    ids = np.array([ix.vocabulary.get(w, -1) for w in words], np.int64)
    keys = (ids[:-1] * WIDE + ids[1:])[(ids[:-1] >= 0) & (ids[1:] >= 0)]
    place = np.minimum(np.searchsorted(ix.keys, keys), len(ix.keys) - 1)
    there = ix.has[:, np.unique(place[ix.keys[place] == keys])].sum(axis=1)
    tries = [t for t in range(len(ix.names)) if there[t] >= low * len(ix.grams[t]) - 1e-6]
    if not tries:
        return None, 0.0, 0
    number = dict(ix.vocabulary)
    best, n_matches, most, further = None, 0, 0, []
    for unit in units(text):
        w = [number.setdefault(x, len(number)) for x in WORD.findall(unit.lower())]
        own = {a * WIDE + b for a, b in zip(w[:-1], w[1:], strict=True)}
        found = []
        for t in tries:
            g = ix.grams[t]
            if own and low * len(g) <= len(own) <= high * len(g):
                shared = len(own & g)
                if (dice := 2.0 * shared / (len(own) + len(g))) >= threshold:
                    found.append((shared, dice, ix.names[t], ix.fixed[t]))
        n_matches += bool(found)
        further += [x[:3] for x in found if not x[3]]
        for shared, dice, name, _ in (x for x in found if x[3]):
            most = max(most, shared)
            best = max(best or (0.0, "", 0), (dice, name, shared))
    ids = np.array([number[w] for w in words], np.int64)
    keys = ids[:-1] * WIDE + ids[1:]
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    prev = np.full(n, -1, np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    prev[order[1:][same]] = order[:-1][same]
    for t in tries:
        g, m = ix.grams[t], ix.lengths[t]
        if n <= m:
            continue
        size = _distinct(prev, np.arange(n), m, n)
        shared = _distinct(prev, np.flatnonzero(np.isin(keys, np.array(sorted(g), np.int64))), m, n)
        dice = 2.0 * shared / (size + len(g))
        ok = dice >= threshold
        if ok.any():
            top = int(shared[ok].max())
            if top > most:
                further.append((top, float(dice[ok & (shared == top)].max()), ix.names[t]))
    if further and (best is None or max(further)[0] > best[2]):
        return max(further)[2], max(further)[1], max(n_matches, 1)
    return (best[1], best[0], n_matches) if best else (None, 0.0, 0)


def scan(df: DataFrame, text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds license (the best match's name), dice, n_matches (units that match any template; 1 if only a window does).

    Of units and TEMPLATES the highest coefficient counts, unless a whole licence or further notice shares more bigrams
    than that, or a window more than any such unit: so a whole licence goes before a short notice within it.  Ties go to the name that sorts last. Nothing
    reaches the threshold, or the text is null or empty: null, 0.0 and 0.  Templates of fewer than two words can't
    match. Added columns replace those of the same name; repeated rows are scanned each; an empty table gives an empty table.
    """
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(index(templates) if templates else standard())
    helper = free_name(df, "__text")
    staged = df.select("*", F.col(f"`{text_col}`").cast("string").alias(helper))
    at = len(staged.columns) - 1

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [match(t or "", shared.value, threshold) for t in batch.column(at).to_pylist()]
        cols = list(zip(*found, strict=True))
        return [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())]

    fields = [T.StructField("license", T.StringType(), True), T.StructField("dice", T.DoubleType(), False), T.StructField("n_matches", T.LongType(), False)]
    return add_columns(staged, fields, run).drop(helper)
