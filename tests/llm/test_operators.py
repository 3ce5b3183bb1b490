"""The training-data operators on small fixtures: brute force, exact round trips, held-out accuracy, and the defined edge cases."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest

from chronofold.llm import byte_bpe, chat_format, decontamination, html_extraction, jaccard_join, license_scan, quality_classifier, quality_rules, token_counts, url_filters
from chronofold.llm import queries as llm_queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "end"
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "Some text of no document at all.", "en", "a", 1), (3, " \t\n ", "en", "a", 3), (4, LONG, "en", None, len(LONG)), (5, "One two three.", "en", "a", 14), (5, "One two three.", "en", "a", 14), (6, "é\x0b\x1cà\u00a0b", "fr", "b", 6)]


@pytest.fixture(scope="module")
def edge(spark):
    """Edge rows, with an extra column whose name an operator might use itself."""
    from pyspark.sql import functions as F

    extra = [F.lit(k).alias(n) for k, n in enumerate(("row", "w", "h", "n", "node", "hub", "host", "score", "key", "part"))]
    return spark.createDataFrame(EDGE, DOCS).select("*", *extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- quality rules


def brute_rules(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else {g for g, k in __import__("collections").Counter(grams).items() if k > 1}
    covered = {i + j for i, g in enumerate(grams) if g in again for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_count_as_brute_force(spark, sf, edge):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(edge.select("doc_id", "text", "lang", "source", "n_chars"))
    got = quality_rules.judge(docs).collect()
    want = sorted((r.doc_id or 0, *brute_rules(r.text)) for r in docs.collect())
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)


def test_a_bad_host_takes_its_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "spam " * 60
    rows = [(i, good, "en", f"h{i % 20}", 1) for i in range(400)] + [(1000 + i, good if i == 0 else bad, "en", "farm", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in quality_rules.judge(docs).filter("kept").collect()}
    assert kept == set(range(400))
    assert {r.doc_id for r in quality_rules.keep(docs).collect()} == kept


def test_quality_rules_keep_returns_rows_as_they_are(edge, empty):
    assert quality_rules.keep(edge).columns == edge.columns
    assert quality_rules.keep(edge).count() == 0
    assert quality_rules.judge(empty).count() == quality_rules.keep(empty).count() == 0


# -- licences


def test_licences_by_family_and_prose_unknown(spark, edge, empty):
    texts = [(10 + i, t, "en", "s", 1) for i, t in enumerate(["Body text here.\nReleased under the MIT License.\nmore", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "The driver lost the license in the public park under a general rule."])]
    got = {r.doc_id: (r.paragraph, r.family, r.confirmed) for r in license_scan.scan(spark.createDataFrame(texts, DOCS)).collect()}
    assert got == {10: (1, "mit", True), 11: (0, "gpl", True), 12: (0, "cc", True), 13: (0, "apache", True)}
    assert license_scan.scan(edge).count() == license_scan.scan(empty).count() == 0


# Statements in other words than the model's own, and prose.
REWORDED = [
    ("agpl", "The server is covered by version 3 of the GNU Affero General Public License."), ("agpl", "Sources are offered under GNU AGPL version 3 only."),
    ("apache", "Made available to you under the Apache License 2.0, see below."), ("apache", "Contributions are accepted under the Apache License, Version 2.0 only."),
    ("bsd", "You can use it under the BSD 3-Clause License."), ("bsd", "Redistribution and use in source and binary forms, with or without changes, are permitted provided that these conditions are met:"),
    ("cc", "Content on this page may be shared under CC BY-SA 4.0 unless noted."), ("cc", "Photos are available under a Creative Commons Attribution 4.0 International License."),
    ("epl", "The plug-in is offered under the terms of the Eclipse Public License v2.0."), ("gpl", "Foo is free software: you may redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "This module may be copied under the GNU GPL version 2 or later."), ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("lgpl", "The library is covered by the GNU Lesser General Public License version 3."), ("mit", "Everything here is yours under the MIT license."),
    ("mit", "Permission is granted, free of charge, to any person obtaining a copy of this software and its documentation files (the Software), to deal in the Software without restriction, subject to the following conditions:"),
    ("mpl", "Parts of this file are subject to the Mozilla Public License 2.0."), ("proprietary", "(c) 2021 Some Company. All rights reserved."), ("proprietary", "Strictly prohibited: unauthorized copying of this file, via any medium."),
    ("unlicense", "This is free and unencumbered software given into the public domain."), ("apache", "License: Apache-2.0"),
]
INNOCENT = [
    "He renewed his license at the public office.", "The committee released its general terms.", "Apache and Mozilla sponsor the meeting.", "A copy of the software was found without a source.", "The MIT team won.", "The following conditions were reported: fog and rain.",
    "Fees are charged for any use of the hall.", "Version 3 of the plan is out.", "The public is free to walk along the river.", "All members keep their rights and duties.",
]


def test_reworded_notices_are_recalled_and_prose_left_alone(spark):
    texts = [t for _, t in REWORDED] + INNOCENT
    assert not set(texts) & {t for ts in license_scan.statements().values() for t in ts} | set(texts) & set(license_scan.PROSE + license_scan.OTHER_PROSE)
    got = {r.doc_id: r.family for r in license_scan.scan(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)).filter("confirmed").collect()}
    right = sum(got.get(i) == f for i, (f, _) in enumerate(REWORDED))
    assert right >= 0.9 * len(REWORDED), [(f, t, got.get(i)) for i, (f, t) in enumerate(REWORDED) if got.get(i) != f]
    assert not [texts[i] for i in got if i >= len(REWORDED)]
    assert got.get(0) == "agpl"


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_a_wrapped_notice_is_one_paragraph(spark, mark):
    import textwrap

    notices = [(f, t) for f, ts in license_scan.TEMPLATES.items() for t in ts if len(t) > 100]
    wrapped = ["\n".join([mark + "Some heading", mark.rstrip()] + [mark + x for x in textwrap.wrap(t, 45)] + [mark.rstrip(), mark + "Other text"]) for _, t in notices]
    got = [(r.doc_id, r.family, r.match) for r in license_scan.scan(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(wrapped)], DOCS)).filter("confirmed").collect()]
    assert {(i, f) for i, f, _ in got} >= {(i, f) for i, (f, _) in enumerate(notices)}
    assert all(any(i == j and m == 1.0 for j, _, m in got) for i in range(len(notices)))


def test_probabilities_of_unseen_variants_are_calibrated():
    """Variants under another seed: of those called a family with probability p, about p or more belong to it."""
    weights, biases = license_scan.fit()
    p, right = [], []
    for grams, family in license_scan._samples(99, license_scan.OTHER_PROSE, ["You get it under the {}."]):
        scores = {f: biases[f] + sum(weights[f].get(g, 0) for g in grams) for f in weights}
        best = max(scores, key=scores.get)
        p.append(1 / (1 + np.exp(-scores[best])))
        right.append(best == family)
    p, right = np.array(p), np.array(right)
    sure = p >= license_scan.MIN_PROBABILITY
    assert right[sure].mean() >= p[sure].mean() - 0.05 and sure[right].mean() > 0.8
    assert right[p < 0.2].mean() < 0.2


def test_anchor_words_lose_no_family(spark):
    """Texts made of model words: the prefilter never changes a result."""
    weights, biases = license_scan.fit()
    rng, vocabulary = random.Random(2), sorted({w for ws in weights.values() for g in ws for w in g.split()})
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 14))) for _ in range(200)] + [t for ts in license_scan.TEMPLATES.values() for t in ts]
    got = {r.doc_id for r in license_scan.scan(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)).collect()}
    least = np.log(license_scan.MIN_PROBABILITY / (1 - license_scan.MIN_PROBABILITY))
    want = {i for i, t in enumerate(texts) if max(biases[f] + sum(weights[f].get(g, 0) for g in license_scan.ngrams(t)) for f in weights) >= least}
    assert got == want


# -- decontamination


def test_wand_finds_what_exhaustive_scoring_finds():
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, ". ".join(" ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(3, 20))) for _ in range(2)) + ".") for i in range(70)]
    index = decontamination.indexes(items, decontamination.Statistics.of([t for _, t in items]))[0]
    for _ in range(200):
        terms, least = rng.sample(range(len(index.items)), rng.randint(1, min(40, len(index.items)))), rng.choice([0.05, 0.2, 0.5])
        scores = np.zeros(len(index.ids))
        for t in terms:
            for k, w in zip(index.items[t], index.impacts[t], strict=False):
                scores[k] += w
        got = index.search(terms, least)
        assert {k for k, _ in got} == set(np.flatnonzero(scores >= least).tolist())
        assert all(abs(scores[k] - s) < 1e-9 for k, s in got)


def test_planted_items_are_found_and_clean_documents_left(spark, sf, edge):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    some = items.limit(6).collect()
    filler = " ".join(f"filler{i}" for i in range(300))
    rows = [(100 + k, f"{filler} {r.text} {filler}", "en", "s", 1) for k, r in enumerate(some)] + [(200, filler, "en", "s", 1), (201, " ".join(some[0].text.split()[:4]), "en", "s", 1)]
    near = some[1].text.split()
    near[len(near) // 3] = "CHANGED"
    rows.append((300, f"{filler} {' '.join(near).upper()} {filler}", "en", "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert got >= {(100 + k, r.item_id) for k, r in enumerate(some)} | {(300, some[1].item_id)}
    assert not {d for d, _ in got} & {200, 201}
    assert {r.doc_id for r in decontamination.clean(docs, items).collect()} == {200, 201}
    assert decontamination.clean(edge, items).columns == edge.columns
    assert decontamination.clean(edge, items).count() == len(EDGE)


def brute_leaks(docs, items, least):
    """Every window against every item: BM25 over statistics of all items, and the overlaps as sets of grams."""
    D = decontamination
    stats = D.Statistics.of([t for _, t in items if t])
    out = {}
    for i, text in items:
        terms = D.terms_of(text)
        if not terms:
            continue
        impact, width = stats.impacts(terms), D.width_of(len(terms))
        parts = D.question_answer(text)
        for d, doc in docs:
            w = D.terms_of(doc)
            for lo in range(0, len(w), width):
                passage = w[lo : lo + 2 * width]
                score = sum(impact.get(t, 0.0) for t in set(passage))
                if score < least - 1e-6:
                    continue
                q, a = (len(D.grams(p, n) & D.grams(passage, n)) / len(D.grams(p, n)) if p else 0.0 for p in parts for n in [min(3, len(p))])
                old = out.get((d, i), (0.0, 0.0, 0.0, 0))
                out[d, i] = (*max(old[:3], (round(score, 6), q, a), key=lambda x: (min(x[1:]), *x)), old[3] + 1)
    return {k: (round(v[0], 5), round(v[1], 9), round(v[2], 9), v[3]) for k, v in out.items()}


@pytest.mark.parametrize("sizes", [(50_000, 8_000_000), (20, 8_000_000), (50_000, 900)])
def test_the_whole_search_as_brute_force(spark, monkeypatch, sizes):
    """One part, many parts, and items that each are a part of their own: the same pairs and scores."""
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(90)]
    some = lambda k: " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(90)], k=k))
    items = [(i, f"{some(rng.randint(2, 30))}. {some(rng.randint(1, 12))}.") for i in range(40)] + [(90, some(200) + ". " + some(9) + "."), (91, "one"), (92, "!"), (93, "")]
    docs = []
    for d in range(60):
        text = items[rng.randrange(len(items))][1].split()
        for _ in range(rng.randint(0, 4)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        docs.append((d, f"{some(rng.randint(0, 150))} {' '.join(text)} {some(rng.randint(0, 150))}"))
    docs += [(100, None), (101, ""), (102, "one"), (103, some(3000))]
    monkeypatch.setattr(decontamination, "PART", sizes[0])
    monkeypatch.setattr(decontamination, "PART_BYTES", sizes[1])
    dd, di = spark.createDataFrame([(i, t, "", "", 0) for i, t in docs], DOCS), spark.createDataFrame([*items, (None, "x y"), (94, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.score, 5), round(r.question_overlap, 9), round(r.answer_overlap, 9), r.n_windows) for r in decontamination.find(dd, di, 0.5).collect()}
    want = brute_leaks(docs, items, 0.5)
    assert got == want and len(want) > 60
    held = {d for (d, _), x in brute_leaks(docs, items, decontamination.THRESHOLD).items() if min(x[1:3]) >= decontamination.OVERLAP}
    assert {r.doc_id for r in decontamination.clean(dd, di).collect()} == {d for d, _ in docs} - held
    assert len(held) > 20


def test_long_items_have_windows_of_their_own(spark):
    rng = random.Random(1)
    text = " ".join(f"x{rng.randrange(10**6)}" for _ in range(200)) + ". " + " ".join(f"y{i}" for i in range(30)) + "."
    items = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "a b c d e f"), (4, text)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "z " * k + text + " z" * 50, "en", "s", 1) for k in (0, 63, 200, 500)], DOCS)
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()} == {(k, i) for k in (0, 63, 200, 500) for i in (1, 4)}
    assert decontamination.leaks(docs, items.limit(0)).count() == decontamination.leaks(docs.limit(0), items).count() == 0


# -- HTML


def test_blocks_decode_and_collapse():
    got = [b.text for b in html_extraction.blocks("<div>a<br>b &amp; c<p>x\n\t y<p>z<b>!</div><script>if(a<b){}</script>tail <a href='q>r'>l</a><!-- no --> end")]
    assert got == ["a b & c", "x y", "z!", "tail l end"]
    assert html_extraction.blocks(None) == html_extraction.blocks("") == html_extraction.blocks("<p></p>") == []
    assert [b.text for b in html_extraction.blocks("plain <b>text")] == ["plain text"]


def test_extraction_matches_the_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(900, None, None), (901, "u", ""), (902, "u", "<p>" * 3000 + "deep"), (903, "u", "<nav><a href=x>Home</a></nav>"), (903, "u", "<nav><a href=x>Home</a></nav>")], "page_id long, url string, html string")
    labeller = html_extraction.train(pages)
    got = {r.page_id: r for r in html_extraction.extract(pages.unionByName(odd), labeller).collect()}
    wrong = 0
    for r in pages.collect():
        seq = html_extraction.blocks(r.html)
        want = "\n".join(b.text for b in seq if any(t == "article" for t, _ in b.place.path()))
        wrong += got[r.page_id].text != want or got[r.page_id].n_chars != len(want)
    assert wrong == 0
    assert got[900].text == got[901].text == got[903].text == "" and got[900].n_chars == 0
    assert html_extraction.extract(pages.limit(0), labeller).count() == 0


def test_deep_and_long_pages_take_time_in_proportion():
    """Open elements without end, stray ends, headings in headings, and very many blocks."""
    import time

    began = time.perf_counter()
    n = 50_000
    for page, count in (("<div>x" * n, n), ("<b>" * n + "<p>y" * 1000, 1000), ("<h2>a" * n + "</table>" * n, n), ("<div class=c>" * n + "z" + "</x>" * n + "</div>" * n, 1), ("<li>q" * n, n)):
        assert len(html_extraction.blocks(page)) == count
    deep = html_extraction.blocks("<div>x" * n)[-1]
    assert deep.place.depth == n and deep.place.mask.bit_length() <= html_extraction.PATH_DIMS
    labeller, features = html_extraction.Labeller(), html_extraction.Features()
    seq = html_extraction.blocks("<p>some words here. " * 3 * html_extraction.CHUNK)
    got = labeller.label([html_extraction.inputs_of(seq, features, labeller)])[0]
    assert len(got) == 3 * html_extraction.CHUNK
    assert time.perf_counter() - began < 60
    whole = labeller.label([labeller.inputs(features(seq))])[0]
    assert np.allclose(got, whole, atol=1e-5)


def test_gradient_of_the_labeller_and_batches():
    """Against finite differences; and a page's labels do not hang on the pages it is labelled with."""
    rng = np.random.default_rng(2)
    labeller = html_extraction.Labeller(seed=4)
    labeller.p = {k: v.astype(np.float64) for k, v in labeller.p.items()}
    seqs = [rng.normal(size=(k, html_extraction.WIDTH)) for k in (1, 4, 7)]
    labels = [rng.integers(0, 2, (len(s), 1)).astype(float) for s in seqs]
    x, live = html_extraction.pad(seqs)
    x, y = x.astype(np.float64), html_extraction.pad(labels)[0][:, :, 0].astype(np.float64)

    def loss():
        out = np.clip(labeller.forward(labeller.inputs(x), live)[0].astype(np.float64), 1e-12, 1 - 1e-12)
        return -((y * np.log(out) + (1 - y) * np.log(1 - out)) * live).sum() / live.sum()

    grads = labeller.gradient(x, live, y)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, k)) for k in labeller.p[name].shape)
            old, e = labeller.p[name][at], 1e-2
            labeller.p[name][at] = old + e
            up = loss()
            labeller.p[name][at] = old - e
            down = loss()
            labeller.p[name][at] = old
            assert abs((up - down) / (2 * e) - g[at]) < 2e-4, name
    single = [labeller.label([labeller.inputs(s)])[0] for s in seqs]
    together = labeller.label([labeller.inputs(s) for s in seqs])
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(single, together, strict=True))


def test_extraction_of_odd_tables(spark, sf):
    from pyspark.sql import functions as F

    labeller = html_extraction.Labeller()
    rows = [(1, "u", "<p>one</p>"), (1, "u", "<p>one</p>"), (None, None, None), (2, None, "<div>" * 20_000 + "deep"), (3, "v", "<article>" + "<p>A sentence of some words stands here.</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("text", "n_chars", "blocks", "path")])
    got = html_extraction.extract(pages, labeller)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 5
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_labeller_generalises_to_new_layouts(spark, sf):
    labeller, features, rng = html_extraction.train(spark.read.parquet(f"{sf}/pages.parquet")), html_extraction.Features(), random.Random(77)
    wrong = total = 0
    for _ in range(120):
        page, marks = html_extraction.make_page(rng, html_extraction.PLAIN, html_extraction.PLAIN)
        seq = html_extraction.blocks(page)
        got = labeller.label([html_extraction.inputs_of(seq, features, labeller)])[0] >= 0.5
        wrong, total = wrong + int((got != np.array(marks)).sum()), total + len(marks)
    assert wrong / total < 0.05


# -- Jaccard join


def brute_components(rows):
    def shingles(text):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def variants(seed):
    """Small sets, chains of near copies on both sides of the bound, and a common passage."""
    rng, out = random.Random(seed), []
    passage = [f"p{i}" for i in range(60)]
    for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 18, 30, 80):
        base = [f"b{n}_{i}" for i in range(n)]
        out.append(base)
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w) + 1)
                w = w[:k] + [f"e{rng.randrange(5)}"] * rng.randint(0, 2) + w[k + rng.randint(0, 1) :]
            out.append(w)
    for i in range(12):
        own = [f"o{i}_{j}" for j in range(rng.randint(1, 40))]
        out.append(own + passage)
    return [(i, " ".join(w).upper() if i % 3 else "\n".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_as_brute_force(spark, seed):
    rows = variants(seed)
    got = jaccard_join.components(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def short_variants():
    """Short texts only, many of them near copies: as links between light sets, each has to be found by a subset."""
    rng, out = random.Random(11), []
    for n in (5, 8, 9, 10, 12, 13, 14, 15):
        for g in range(3):
            base = [f"s{n}_{g}_{i}" for i in range(n)]
            out += [base, base[:-1], ["x", *base], [*base, f"y{g}"], base[1:], [*base, "z", "z"]]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_light_sets_meet_by_subsets_alone(spark, monkeypatch):
    """With all sets light nothing comes from the lists: without subsets every link is lost."""
    rows = short_variants()
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    want = brute_components(rows)
    assert sum(c != i for i, _, c in want) > 60
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda costs: 13)
    assert sorted(map(tuple, jaccard_join.components(docs).collect())) == want
    whole = jaccard_join.signatures
    monkeypatch.setattr(jaccard_join, "signatures", lambda s, level, light: (whole(s, level, light)[0], np.empty(0, np.uint64)))
    sizes = {i: n for i, n, _ in want}
    got = sorted(map(tuple, jaccard_join.components(docs).collect()))
    assert all(c == i or 13 in (sizes[i], sizes[c]) or sizes[i] > 13 for i, _, c in got)
    assert sum(c != i for i, _, c in got) < sum(c != i for i, _, c in want) / 2


@pytest.mark.parametrize("light", [0, 6, 9])
def test_any_boundary_gives_the_same_components(spark, monkeypatch, light):
    rows = [(i, t) for i, (_, t) in enumerate(short_variants() + variants(3))]
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda costs: light)
    got = jaccard_join.components(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_the_boundary_follows_the_lists():
    """Short lists: no subsets beyond those that equal the set. Long lists: subsets of larger sets, too, and never for nothing."""
    n = jaccard_join
    short = {k: (100, 100 * n.prefix_length(k) * 1.2) for k in range(1, 65)}
    long = {k: (100, 100 * n.prefix_length(k) * 51.2) for k in range(1, 65)}
    assert n.choose_boundary(short) <= 4 < n.choose_boundary(long) < 20
    assert n.choose_boundary({}) == 0
    assert all(n.n_subsets(k) > n.prefix_length(k) * 2.5e11 for k in range(n.MOST + 1, 120))
    for costs in (short, long):
        x = n.choose_boundary(costs)
        total = lambda y: sum((k * n.n_subsets(s) if s <= y else 0) + (c if n.meets_heavy(s, y) else 0) for s, (k, c) in costs.items())
        assert total(x) == min(map(total, range(65)))


def test_sketches_are_summed_up_a_tree(spark, monkeypatch):
    rows = [(i, f"a b c d e f{i % 7} g h{i}", "", "", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(23)
    sketches = lambda: jaccard_join._sets(docs).filter("part IS NOT NULL")
    flat = jaccard_join._levels(sketches())
    monkeypatch.setattr(jaccard_join, "FAN", 3)
    assert np.array_equal(jaccard_join._levels(sketches()), flat)
    counts = np.zeros(jaccard_join.SKETCH)
    for s in jaccard_join.Shingler()([r[1] for r in rows]):
        np.add.at(counts, (s % np.uint64(jaccard_join.SKETCH)).astype(np.int64), 1)
    assert np.array_equal(flat, (2 * np.log2(counts + 1)).astype(np.uint8))


def test_large_hubs_are_checked_in_blocks(spark, monkeypatch):
    """Blocks of 8: hubs of several blocks, with members outside the main component."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng, rows = random.Random(5), []
    base = [f"w{i}" for i in range(120)]
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.components(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_components_of_edge_cases(edge, empty, spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(edge).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 1, 5), (6, 1, 6)} <= got
    assert jaccard_join.components(empty).count() == jaccard_join.dedupe(empty).count() == 0
    kept = jaccard_join.dedupe(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.choice([3, 40, 500, 520, 3000]))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.92], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 9))).astype(np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert jaccard_join.may_link(np.array([len(a), len(b)]), [jaccard_join.bitmap(a), jaccard_join.bitmap(b)]).all()


# -- tokens


def test_bpe_is_that_of_the_library(spark, sf, edge):
    import tiktoken

    path, pattern = byte_bpe.vocabulary()
    c = byte_bpe.codec(path, pattern)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choices("ab c.!?-=\n\té漢🙂'stl0129", k=rng.choice([1, 7, 60, 400]))) for _ in range(300)] + ["a" * 20_000, "!?" * 9_000, "<|endoftext|>", "x" + "é" * 3000, LONG]
    for t in texts:
        ids = c.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(t)
        assert c.decode(ids) == t.encode()
    assert c.decode(np.arange(3 * byte_bpe.IDS + 7, dtype="<u4").tobytes()) == b"".join(c.bytes_of[i] for i in range(3 * byte_bpe.IDS + 7))
    assert max(map(len, c.packed)) <= byte_bpe.KEPT, "no long match stays in memory"
    assert all(c.loop(t) == [r] for t, r in c.ranks.items()), "each token is the encoding of its own bytes"
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(edge, path, pattern).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {(i, len(x := own.encode_ordinary(t or "")), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for i, t, *_ in EDGE}
    rows = byte_bpe.encode(edge, path, pattern).collect()
    assert all(bytes(r.decoded) == c.decode(np.array(r.ids, "<u4").tobytes()) for r in rows)


def test_join_of_any_two_encodings():
    path, pattern = byte_bpe.vocabulary()
    c, rng = byte_bpe.codec(path, pattern), random.Random(8)
    for _ in range(400):
        data = bytes(rng.choices(b"aabtheinreon st", k=rng.randint(0, 70)))
        k = rng.randint(0, len(data))
        assert c.join(c.encode_bytes(data[:k]), c.encode_bytes(data[k:])) == (c.merge(data) if data else [])
    assert base64.b64decode(open(path, "rb").readline().split()[0]) in c.ranks


def test_token_counts(spark, sf, edge, empty):
    path, pattern = byte_bpe.vocabulary()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").unionByName(edge.select("text"))
    lengths = [len(byte_bpe.codec(path, pattern).encode(r.text)) // 4 for r in docs.collect()]
    hist = token_counts.histogram(docs, path, pattern)
    rows = token_counts.suffix_sums(hist).collect()
    assert all(abs(r.share_upto - sum(y <= r.n_tokens for y in lengths) / len(lengths)) < 1e-12 for r in rows)
    for q in (0.1, 0.5, 0.99):
        assert min(r.n_tokens for r in rows if r.share_upto >= q - 1e-12) == sorted(lengths)[-(-int(q * 1000) * len(lengths) // 1000) - 1]
    got = {tuple(r)[:5] for r in rows}
    assert got == {(x, lengths.count(x), sum(y >= x for y in lengths), sum(y for y in lengths if y >= x), sum(min(x, y) for y in lengths)) for x in set(lengths)}
    answers = {(r.question, r.argument): r.answer for r in token_counts.answers(hist, [100, 2048]).collect()}
    assert answers["tokens", 0.0] == sum(lengths) and answers["documents", 0.0] == len(lengths)
    assert answers["truncated", 100.0] == sum(min(100, y) for y in lengths)
    assert answers["quantile", 0.5] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts.suffix_sums(token_counts.histogram(empty, path, pattern)).count() == 0


# -- chat


def test_calls_meet_results(spark, empty):
    call = lambda *cs: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), c, strict=True)) for c in cs]})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("a", "search", {"query": "x", "limit": 3}), ("b", "weather", {"days": "two"}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "rain"})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (2, 0, "tool", json.dumps({"tool_call_id": "c", "content": "early"})), (2, 1, "assistant", call(("c", "fetch", {"url": "u", "z": 1}))), (2, 2, "assistant", call(("c", "nope", {}))),
        (3, 0, None, None), (None, 0, "tool", json.dumps({"tool_call_id": "a"})), (4, 0, "assistant", '{"tool_calls": [{"id": "q", "name": "fetch", "arguments": "no json"}]}'), (3, 0, None, None),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("calls", F.lit(1)).withColumn("json", F.lit(2))
    got = {(r.conv_id, r.turn): r for r in chat_format.format_chat(df).collect()}
    assert got[1, 1].errors == "missing:city,type:days,unanswered" and got[1, 1].n_calls == 2
    assert got[1, 1].json == '{"conv_id":1,"role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search"},{"arguments":{"days":"two"},"id":"b","name":"weather"}],"turn":1}'
    assert (got[1, 2].linked_turn, got[1, 2].errors, got[1, 2].order_rank) == (1, "", 1)
    assert got[1, 3].errors == "orphan_result" and got[None, 0].errors == "orphan_result"
    assert (got[2, 0].errors, got[2, 0].order_turn, got[2, 0].order_rank) == ("out_of_order", 1, 1)
    assert got[2, 1].errors == "unexpected:z" and got[2, 2].errors == "duplicate_id,unknown_tool"
    assert got[3, 0].json == '{"conv_id":3,"role":"unknown","turn":0}' and got[4, 0].errors == "bad_arguments,unanswered"
    assert chat_format.format_chat(df).count() == len(rows)
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_types_are_those_of_the_parsed_value(spark):
    """A number is no string and a string no number, whatever it looks like."""
    cases = [
        ("search", '{"query": 5, "limit": "3"}', "type:limit,type:query,unanswered"), ("weather", '{"city": ["x"], "metric": "true"}', "type:city,type:metric,unanswered"),
        ("search", '{"query": "5", "limit": 3}', "unanswered"), ("weather", '{"city": "x", "metric": true, "days": 1.5}', "type:days,unanswered"), ("weather", '{"city": null}', "type:city,unanswered"),
        ("search", '{"query": {"a": 1}, "limit": 0.5}', "type:limit,type:query,unanswered"), ("fetch", '["url"]', "bad_arguments,unanswered"), ("fetch", '{"url": "a", "url": "b"}', "bad_arguments,unanswered"), ("fetch", "{}", "missing:url,unanswered"),
        ("search", json.dumps(json.dumps({"query": "as a string"})), "unanswered"),
    ]
    rows = [(k, 0, "assistant", f'{{"tool_calls": [{{"id": "a", "name": "{name}", "arguments": {args}}}]}}') for k, (name, args, _) in enumerate(cases)]
    got = {r.conv_id: r.errors for r in chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(cases)}


def test_the_sql_links_as_the_query_does(spark, tmp_path):
    """Random conversations with calls, results, repeats and faults: query and SQL give the same rows."""
    duckdb = pytest.importorskip("duckdb")
    rng, rows = random.Random(21), []
    arguments = [{"query": "x", "limit": 3}, {"limit": "3"}, {"url": "http://a/b", "z": 1}, {"city": "Rome", "days": 2, "metric": True}, {"city": 5}, {}, {"expression": "1+1"}, [1], "no json", None]
    for conv in range(80):
        for turn in range(rng.randint(1, 9)):
            kind, i = rng.random(), rng.choice("abcd")
            if kind < 0.35:
                calls = [{"id": rng.choice([*"abcd", None]), "name": rng.choice(["search", "fetch", "weather", "calculate", "nope"]), "arguments": rng.choice(arguments)} for _ in range(rng.randint(0, 3))]
                text = json.dumps({"tool_calls": calls} | ({"content": 'He said "so"'} if rng.random() < 0.3 else {}))
                rows.append((conv, turn, "assistant", text))
            elif kind < 0.75:
                rows.append((conv, turn, rng.choice(["tool", "Tool"]), json.dumps({"tool_call_id": i, "content": "done"})))
            else:
                rows.append((conv, turn, rng.choice(["user", "system", None, "assistant"]), rng.choice(["hi", None, "{not json", "line\nbreak", "{}"])))
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in chat_format.format_chat(messages).collect()), key=str)
    messages.coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    cur = con.execute(chat_format.ORACLE_SQL)
    assert [d[0] for d in cur.description] == chat_format.format_chat(messages).columns
    want = sorted(cur.fetchall(), key=str)
    assert got == want
    assert sum(r[6] is not None for r in got) > 30 and sum(r[4] for r in got) > 30 and any("out_of_order" in r[7] for r in got)


# -- urls


def test_longest_rule_wins(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "a.example.net/en/x"), ("allow", "net/en/"), ("block", "com/"), ("block", "other.com/")]
    rng = random.Random(6)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "notexample.net", "example.com", "x.other.com", "netx", "xnet", "Example.NET", ""]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/en/x1', '/EN/', '/de/?q=/en/', '?/en/', '#/en/'])}" for _ in range(400)] + [None, "", "no scheme.net/", "x://y://net/", "://net/"]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("key", F.lit(1)).withColumn("salt", F.lit(1)).withColumn("stack", F.lit(1))

    def want(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()), key=str)
    assert got == sorted(((i, *want(u)) for i, u in [*enumerate(urls), (0, urls[0])]), key=str)
    assert url_filters.judge(pages, []).filter("verdict <> 'allow'").count() == 0
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def test_many_rules_and_a_hot_host(spark):
    """Thousands of nested rules, most urls on one host, one very long url; against a walk up the labels."""
    import time

    rng = random.Random(12)
    label = lambda: f"l{rng.randrange(12)}"
    rules = sorted({(rng.choice(["block", "allow"]), ".".join(label() for _ in range(rng.randint(1, 5))) + rng.choice(["/", "/a/", "/a/b"])) for _ in range(12_000)})
    urls = [f"https://{'l1.l2.l3.l4' if k % 3 else '.'.join(label() for _ in range(rng.randint(1, 6)))}/{rng.choice(['', 'a/', 'a/b/c', 'b'])}" for k in range(3000)] + ["http://l1.l2/a/" + "x" * 300_000, "http://" + "l1." * 20_000 + "l2/a/"]
    by_host = {}
    for v, r in rules:
        by_host.setdefault(r.partition("/")[0], []).append((len(r), r, v))

    def want(url):
        host, _, path = url.split("://")[1].partition("/")
        labels = host.split(".")
        fit = [x for k in range(max(0, len(labels) - 6), len(labels)) for x in by_host.get(".".join(labels[k:]), ()) if ("/" + path).startswith(x[1][x[1].index("/") :])]
        return max(fit)[1:] if fit else (None, "allow")

    began = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert time.perf_counter() - began < 60
    assert got == {k: want(u) for k, u in enumerate(urls)}


# -- quality classifier


def test_classifier_holds_out_and_generalises(spark, edge, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality_classifier.score(docs, model).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(got) > 60 and sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.95
    flipped = labels.withColumn("quality", __import__("pyspark").sql.functions.expr("CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END"))
    other = quality_classifier.train(docs, flipped)
    assert all(np.array_equal(model.p[k], other.p[k]) for k in model.p), "held-out labels are not learned from"
    scored = quality_classifier.score(edge, model).collect()
    assert len(scored) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert quality_classifier.reject(edge, model).columns == edge.columns
    assert quality_classifier.score(empty, model).count() == 0
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(edge, none).collect()} == {0.5}


def test_forward_of_the_classifier_as_written_out():
    """Gated attention by plain loops, one bag and one passage at a time."""
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(int(k), quality_classifier.WIDTH)).astype(np.float32) for k in rng.integers(1, 6, 30)]
    model = quality_classifier.fit(bags, np.arange(30) % 2, epochs=3)
    p, want = model.p, []
    for bag in bags:
        codes = [np.tanh(((x - p["mean"]) / p["std"]) @ p["W"] + p["b"]) for x in bag]
        gates = [float(np.exp(sum(np.tanh(h @ p["V"][:, j]) / (1 + np.exp(-(h @ p["U"][:, j]))) * p["w"][j] for j in range(len(p["w"]))))) for h in codes]
        z = sum(g / sum(gates) * h for g, h in zip(gates, codes, strict=True))
        want.append(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))))
    assert np.allclose(model.scores(bags), want, atol=1e-6)
    assert np.allclose(np.concatenate([model.scores([b]) for b in bags]), want, atol=1e-6), "a bag's score does not hang on its batch"


def test_training_rows_are_the_same_whatever_repeats(spark, monkeypatch):
    """Repeated doc_ids, with equal and other texts, and a budget of passages."""
    good, bad = "A fair sentence stands here, and another one follows it. ", "### $$ BUY now!!! ### "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 5), "en", "s", 1) for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    again = rows + rows[:40] + [(i, "other text " * 9, "en", "s", 1) for i in range(5)]
    a = quality_classifier.train(spark.createDataFrame(again, DOCS), labels)
    b = quality_classifier.train(spark.createDataFrame(again[::-1], DOCS).repartition(7), labels)
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda bags, y: seen.append(bags))
    monkeypatch.setattr(quality_classifier, "PASSAGES", 20)
    quality_classifier.train(spark.createDataFrame(again, DOCS), labels)
    assert 0 < len(seen[0]) <= 20 and sum(map(len, seen[0])) <= 20


def test_gradient_of_the_classifier():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(int(k), quality_classifier.WIDTH)).astype(np.float32) for k in rng.integers(1, 6, 40)]
    y = np.array([float(b[:, 0].max() > 0.5) for b in bags])
    model = quality_classifier.fit(bags, y, epochs=200)
    assert ((model.scores(bags) >= 0.5) == (y == 1)).mean() > 0.95


def test_every_operator_has_a_query():
    names = sorted(llm_queries.queries(), key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
    assert set(llm_queries.oracle_sql()) <= set(names)
