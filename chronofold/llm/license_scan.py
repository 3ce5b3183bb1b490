"""License scans: a trained paragraph classifier over word n-grams, confirmed by comparison with templates.

A paragraph is a run of lines: it ends at a line without words, or with a line that ends a sentence (one of . ! ? : and
closing quotes or brackets), so a notice wrapped over lines is one paragraph, whatever comment marks its lines begin with.
Each paragraph is scored for every licence family by sparse logistic regression over the presence of word 1- and 2-grams;
most n-grams have no weight at all. A predicted family is confirmed if the paragraph holds at least MIN_MATCH of the n-grams
of one of the family's templates, or the template at least that share of the paragraph's.

The model is fitted by proximal gradient steps over the fixed templates below, noisy variants of them, and prose; it sees no
corpus row. The unknown class is calibrated: each family's scores are mapped to probabilities by a slope and an offset fitted
on other variants and other prose than those that set the weights, and a paragraph for which no family reaches
MIN_PROBABILITY is unknown. The weights are one small constant (bounded by the templates). Scoring is DataFrame functions
alone, within the row: a paragraph's n-grams meet the vocabulary as a set, and only those found are weighed. Paragraphs
without any anchor word (see anchors()) provably reach no family, and that is tested first.

Defined results: a null or empty text has no paragraphs and no licence; very long texts are scanned whole, and one without
line ends is one paragraph; repeated paragraphs and rows count each; a paragraph that two families claim equally goes to the
better match, then to the last by name; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PROBABILITY, MIN_MATCH = 0.8, 0.6

# Forms of licence statements by family.
TEMPLATES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Released under the AGPL v3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Distributed under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution-ShareAlike License.",
        "Text released under Creative Commons CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Released under the Eclipse Public License.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL v3 or later.",
        "Distributed under the terms of the GPL version 2.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Released under the LGPL v2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Distributed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright Example Ltd. All rights reserved.",
        "Unauthorized copying of this file is strictly prohibited.",
        "This document is proprietary and confidential.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Dedicated to the public domain.",
        "Released into the public domain by the author.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
# The names by which short statements call a family, and such statements, for the weights and for the calibration.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License version 3", "GNU AGPL", "AGPL v3", "AGPLv3"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD-style license"],
    "cc": ["CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC0", "Creative Commons Attribution License", "Creative Commons Attribution-ShareAlike 4.0 License"],
    "epl": ["Eclipse Public License", "Eclipse Public License v2.0", "EPL 2.0"],
    "gpl": ["GNU General Public License", "GNU General Public License version 2", "GNU GPL", "GPL v3 or later", "GPLv3", "GPL version 2"],
    "isc": ["ISC License", "ISC-style license", "ISC"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License version 3", "GNU LGPL", "LGPL v2.1 or later", "LGPLv3"],
    "mit": ["MIT License", "MIT/X11 License", "Expat MIT License"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "unlicense": ["Unlicense", "Unlicense (public domain)"],
}
PHRASES = ["{}", "Released under the {}.", "Licensed under the {}.", "Distributed under the terms of the {}.", "This file is free software under the {}."]
OTHER_PHRASES = ["This project is available under the {}.", "The code is provided under {}.", "See the file for the {}."]
# Words that say nothing of a licence when they stand without others.
FUNCTION_WORDS = set("a all an and any are as at be by can do for from if in is it may not of on one or see so that the this to under was were with without you".split())
# Prose that names licences or shares words with them without granting anything, for the weights ...
PROSE = [
    "The driver lost the license after the accident.", "She released the results under pressure from the public.", "Version 2.0 of the program is free for all.",
    "The terms of the work are subject to change without notice.", "Use of the software in this form is not permitted here.", "All the rights of the people were discussed.",
    "He works at MIT in a general department.", "The public works of the city are under repair.", "A copy of the file is in the source.", "the of and to in a is that for it with as was on be by this are from or",
    "Apache helicopters flew over the general area.", "Creative people share common goals.", "Free of charge, the museum is open to any person.", "The following conditions are met in both forms.",
    "The eclipse was visible to the public in the north.", "The library is open and you can return books at any later date.", "Distributed systems release resources under load.", "The list of conditions was reserved for members.",
    "The foundation published a new version of its general report.", "Common law grants the public a right of way.", "The domain of the function is public knowledge.", "The public domain is discussed in the next chapter.", "The MIT press published a book about the license.", "The GNU project was founded long ago.", "The Apache web server serves files under load.", "He read the license in the library.", "You should have received a letter along with this parcel.",
]
# ... and for the calibration.
OTHER_PROSE = [
    "A fishing license is required at the lake.", "Students at MIT released a report on public transport.", "The software version was released in March.", "All seats are reserved for guests.",
    "The public may use the source of the river free of charge.", "The general asked the public to obtain a copy of the notice.", "Copying of the paintings is common.", "Materials are available in the library under the stairs.",
    "The Apache nation lives in the south.", "The terms of the agreement were published by the foundation.", "A solar eclipse is a rare public event.", "Mozilla and Apache are foundations.",
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: str) -> list[str]:
    """Words in lower case (A-Z): runs of letters, digits and dots within numbers, as the Column form below makes them."""
    low = "".join(_LOWER[_UPPER.index(c)] if c in _UPPER else c for c in text)
    return [w for w in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ") if w]


def statements() -> dict[str, list[str]]:
    """What a paragraph is compared with: templates and bare names, by family."""
    return {family: texts + NAMES.get(family, []) for family, texts in TEMPLATES.items()}


def ngrams(text: str) -> set[str]:
    w = tokens(text)
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def _samples(seed: int, prose: list[str], phrases: list[str]) -> list[tuple[set[str], str | None]]:
    """Short statements, and templates with a word dropped, replaced, or words put around them, under their family; prose and loose words under none."""
    rng = random.Random(seed)
    everyday = sorted({w for p in PROSE for w in tokens(p)} | {w for ts in TEMPLATES.values() for t in ts for w in tokens(t)})
    plain = sorted({w for p in PROSE for w in tokens(p)})
    rows: list[tuple[set[str], str | None]] = []
    rows += [(ngrams(p.format(name)), family) for family, names in NAMES.items() for name in names for p in phrases]
    for family, texts in TEMPLATES.items():
        for t in texts:
            w = tokens(t)
            rows.append((ngrams(t), family))
            for _ in range(3):
                k = rng.randrange(len(w))
                rows.append((ngrams(" ".join(rng.choices(plain, k=rng.randint(0, 6)) + w + rng.choices(plain, k=rng.randint(0, 6)))), family))
                if len(w) > 6:
                    rows.append((ngrams(" ".join(w[:k] + rng.choices(plain, k=1) + w[k + 1 :])), family))
                    rows.append((ngrams(" ".join(w[:k] + w[k + 1 :])), family))
    rows += [(ngrams(p), None) for p in prose for _ in range(3)]
    return rows + [(ngrams(" ".join(rng.choices(everyday, k=rng.randint(1, 40)))), None) for _ in range(250)]


def _presence(rows: list[tuple[set[str], str | None]], column: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(column) + 1))
    x[:, -1] = 1.0
    for i, (grams, _) in enumerate(rows):
        x[i, [column[g] for g in grams if g in column]] = 1.0
    return x


def _sparse_weights(x: np.ndarray, y: np.ndarray, shrink: float, steps: int) -> np.ndarray:
    """Logistic regression of each column of y on x by accelerated proximal steps; the last feature is the bias and not shrunk."""
    v = np.ones(x.shape[1])
    for _ in range(30):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 4 * len(x) / (1.02 * float(v @ (x.T @ (x @ v))))
    w = ahead = np.zeros((x.shape[1], y.shape[1]))
    for k in range(steps):
        new = ahead - rate * (x.T @ (1 / (1 + np.exp(-(x @ ahead))) - y)) / len(x)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * shrink, 0.0)
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


def _calibration(scores: np.ndarray, of_family: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make scores log odds on rows the weights have not seen, by Newton steps on smoothed targets."""
    yes, no = int(of_family.sum()), int((~of_family).sum())
    target = np.where(of_family, (yes + 1) / (yes + 2), 1 / (no + 2))
    x, theta = np.stack([scores, np.ones(len(scores))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ theta)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        theta = theta - step / max(1.0, float(np.abs(step).max()))
    return max(float(theta[0]), 1e-3), float(theta[1])


@lru_cache(maxsize=1)
def fit(steps: int = 600, shrink: float = 0.0008) -> tuple[dict[str, dict[str, float]], dict[str, float]]:
    """Weights by family and n-gram, and biases, both with the calibration worked in: their sum is the log odds of the family."""
    training, others = _samples(17, PROSE, PHRASES), _samples(18, OTHER_PROSE, OTHER_PHRASES)
    df: dict[str, int] = {}
    for grams, _ in training:
        for g in grams:
            df[g] = df.get(g, 0) + 1
    vocabulary = sorted(g for g, k in df.items() if k > 2 and not set(g.split(" ")) <= FUNCTION_WORDS)
    column = {g: i for i, g in enumerate(vocabulary)}
    names = list(TEMPLATES)
    w = _sparse_weights(_presence(training, column), np.array([[float(f == name) for name in names] for _, f in training]), shrink, steps)
    unseen = _presence(others, column)
    weights, biases = {}, {}
    for j, name in enumerate(names):
        slope, offset = _calibration(unseen @ w[:, j], np.array([f == name for _, f in others]))
        weights[name] = {g: round(slope * float(w[i, j]), 6) for i, g in enumerate(vocabulary) if abs(w[i, j]) > 1e-3}
        biases[name] = round(slope * float(w[-1, j]) + offset, 6)
    return weights, biases


def _array(items: list[str]) -> Column:
    """A constant array of words or n-grams, none of which holds a line end."""
    return F.split(F.lit("\n".join(items)), "\n") if items else F.expr("cast(array() as array<string>)")


# of lower-cased text: what ends a sentence at the end of a line, and what lies between paragraphs (lines without words)
_SENTENCE_END = r"""([.!?:]["')\]]*[ \t\r]*)\n"""
_BETWEEN = r"\n[\x00-\x2f\x3a-\x60\x7b-\x7f]*\n"


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its number from 0) and grams of each paragraph that holds an anchor, and so can reach a family at all."""
    weights, _ = fit()
    anchored = r"(?:^|[^a-z0-9\x{80}-\x{10ffff}])(?:" + "|".join(anchors(weights)) + r")(?:$|[^a-z0-9\x{80}-\x{10ffff}])"
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select("doc_id", low.alias("low")).filter(F.col("low").rlike(anchored))
    rows = rows.select("doc_id", F.posexplode(F.split(F.regexp_replace("low", _SENTENCE_END, "$1\n\n"), _BETWEEN)).alias("paragraph", "par")).filter(F.col("par").rlike(anchored))
    words = F.array_remove(F.split(F.regexp_replace("par", r"[\x00-\x2f\x3a-\x60\x7b-\x7f]", " "), " "), "")
    rows = rows.select("doc_id", "paragraph", words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with("w", F.expr("slice(w, 2, size(w))"), lambda a, b: F.concat_ws(" ", a, b))).otherwise(_array([]))
    pairs = F.filter(pairs, lambda x: ~x.endswith(" "))
    return rows.select("doc_id", "paragraph", F.array_distinct(F.concat("w", pairs)).alias("grams"))


def anchors(weights: dict[str, dict[str, float]]) -> list[str]:
    """Words of which a paragraph needs one at least, to reach any family: without them, even all other n-grams fall short.

    Greedy, and exact: the words of greatest weight are taken until no family can be reached by the n-grams free of them.
    """
    _, biases = fit()
    least = math.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY))
    out: set[str] = set()
    for family, ws in weights.items():
        by_word: dict[str, float] = {}
        for g, v in ws.items():
            if v > 0:
                for word in set(g.split(" ")) - FUNCTION_WORDS:
                    by_word[word] = by_word.get(word, 0.0) + v
        for word in sorted(by_word, key=lambda x: (-by_word[x], x)):
            if biases[family] + sum(v for g, v in ws.items() if v > 0 and not out & set(g.split(" "))) < least:
                break
            out.add(word)
    return sorted(out)


def _logit(table: Column, bias: float) -> Column:
    return F.aggregate("found", F.lit(bias), lambda a, g: a + F.coalesce(F.try_element_at(table, g), F.lit(0.0)))


def _match(family: Column) -> Column:
    """Best share of a template of this family in the grams, or of the grams in the template."""
    out = F.lit(0.0)
    for name, texts in statements().items():
        shared = [(F.size(F.array_intersect("grams", _array(sorted(ngrams(t))))), len(ngrams(t))) for t in texts]
        out = F.when(family == name, F.greatest(*(F.greatest(k / n, k / F.size("grams")) for k, n in shared), F.lit(0.0))).otherwise(out)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, family, probability, match (best share of a template) and confirmed, of each paragraph not unknown."""
    weights, biases = fit()
    rows = paragraphs(docs)
    vocabulary = sorted({g for ws in weights.values() for g in ws})
    # explode() of one element keeps the optimizer from copying what it holds into the filters above it
    rows = rows.select("doc_id", "paragraph", F.explode(F.array(F.struct("grams", F.array_intersect("grams", _array(vocabulary)).alias("found")))).alias("p")).select("doc_id", "paragraph", "p.*")
    scores = [F.struct(_logit(F.map_from_arrays(_array(list(ws)), F.array(*(F.lit(v) for v in ws.values()))), biases[f]).alias("logit"), F.lit(f).alias("family")) for f, ws in weights.items()]
    least = math.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY))
    likely = F.filter(F.array(*scores), lambda s: s["logit"] >= least)
    rows = rows.select("doc_id", "paragraph", "grams", F.explode(F.array(likely)).alias("likely")).filter(F.size("likely") > 0)
    # few paragraphs come this far: compare them with the templates of the likely families
    best = F.array_max(F.transform("likely", lambda s: F.struct(s["logit"].alias("logit"), _match(s["family"]).alias("match"), s["family"].alias("family"))))
    rows = rows.select("doc_id", "paragraph", best.alias("best"))
    return rows.select("doc_id", "paragraph", F.col("best.family").alias("family"), F.round(1 / (1 + F.exp(-F.col("best.logit"))), 6).alias("probability"), F.round("best.match", 6).alias("match"), (F.col("best.match") >= MIN_MATCH).alias("confirmed"))


def families(docs: DataFrame) -> DataFrame:
    """doc_id and families (sorted, confirmed ones) of each document that has any."""
    return scan(docs).filter("confirmed").groupBy("doc_id").agg(F.sort_array(F.collect_set("family")).alias("families"))


def oracle_sql() -> str:
    """The same scan in SQL, with the fitted weights as values."""
    weights, biases = fit()
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(f)}, {quote(g)}, {v}::DOUBLE)" for f, ws in weights.items() for g, v in ws.items())
    bias = ", ".join(f"({quote(f)}, {b}::DOUBLE)" for f, b in biases.items())
    forms = ", ".join(f"({quote(f)}, {k}, {quote(g)}, {len(ngrams(t))})" for f, ts in statements().items() for k, t in enumerate(ts) for g in sorted(ngrams(t)))
    return rf"""
WITH wt(family, g, v) AS (VALUES {values}), bs(family, b) AS (VALUES {bias}), tp(family, t, g, n) AS (VALUES {forms}),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {quote(_SENTENCE_END)}, '\1' || chr(10) || chr(10), 'g'), {quote(_BETWEEN)}) AS ls FROM documents),
p AS (SELECT k, doc_id, unnest(range(0, len(ls))) AS paragraph, unnest(ls) AS par FROM d),
w AS (SELECT k, doc_id, paragraph, list_filter(string_split(regexp_replace(par, '[\x00-\x2f\x3a-\x60\x7b-\x7f]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM p),
g AS (SELECT DISTINCT k, doc_id, paragraph, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w),
n AS (SELECT k, paragraph, count(*) AS m FROM g GROUP BY ALL),
s AS (SELECT k, doc_id, paragraph, family, sum(v) + any_value(b) AS logit FROM g JOIN wt USING (g) JOIN bs USING (family) GROUP BY ALL),
o AS (SELECT k, paragraph, family, max(greatest(c / n, c / m)) AS match FROM (SELECT k, paragraph, family, t, count(*) AS c, any_value(tp.n) AS n FROM g JOIN tp USING (g) GROUP BY ALL) JOIN n USING (k, paragraph) GROUP BY ALL),
b AS (SELECT s.k, doc_id, s.paragraph, s.family, logit, coalesce(match, 0) AS match FROM s LEFT JOIN o ON o.k = s.k AND o.paragraph = s.paragraph AND o.family = s.family
  QUALIFY row_number() OVER (PARTITION BY s.k, s.paragraph ORDER BY logit DESC, match DESC NULLS LAST, s.family DESC) = 1)
SELECT doc_id, paragraph::INT AS paragraph, family, round(1 / (1 + exp(-logit)), 6) AS probability, round(match, 6) AS match, match >= {MIN_MATCH} AS confirmed
FROM b WHERE logit >= {math.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY))!r}
"""
