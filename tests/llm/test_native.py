"""URL models, license scan and mixing beside plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
import regex as rx

from reefpulse.llm import license_scan, url_filter
from reefpulse.llm.license_scan import scan_licenses
from reefpulse.llm.mixing import mix, source_targets
from reefpulse.llm.queries import QUERIES, REJECT_WORDS, URL_RULES
from reefpulse.llm.url_filter import judge_urls
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.small import DOCS, LOWER, docs, odd_rows, prose, with_clashes, words

PAGES = "page_id long, url string, html string"


def split_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def rule_of(host, path):
    fit = []
    for verdict, rule in URL_RULES:
        at, _, rest = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest):
            fit.append((len(rule), rule, verdict))
    return max(fit)[1:] if fit else (None, None)


def classes(host, path):
    folded = re.sub("[1-9]", "0", (host + path).translate(LOWER))
    return [url_filter.CLASSES.find(c) + 1 or 31 for c in folded] + [0]


def test_url_models_equal_brute_force(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet")
    aside = {r.page_id: r.aside for r in pages.select(
        "page_id", url_filter.kept_aside(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("aside")).collect()}
    urls = {r.page_id: split_url(r.url) for r in pages.collect()}
    label = {}
    for p, (host, path) in urls.items():
        verdict = rule_of(host, path)[1]
        if verdict or re.search(rf"(^|[.-])({'|'.join(REJECT_WORDS)})([.-]|$)", host):
            label[p] = verdict == "allow"
    n = {True: Counter(), False: Counter()}
    for p, ok in label.items():
        if not aside[p]:
            a = b = 0
            for c in classes(*urls[p]):
                for gram in ((c,), (b, c), (a, b, c)):
                    n[ok][gram] += 1
                n[ok]["all"] += 1
                n[ok]["after", b] += 1
                n[ok]["after", a, b] += 1
                a, b = b, c

    def log_p(m, a, b, c):
        p = (m[c,] + 1) / (m["all"] + 32)
        p = (m[b, c] + 4 * p) / (m["after", b] + 4)
        if m["after", a, b] >= 4:
            p = (m[a, b, c] + 4 * p) / (m["after", a, b] + 4)
        return math.log(p)

    def score(p):
        total, a, b = 0.0, 0, 0
        cs = classes(*urls[p])
        for c in cs:
            total += log_p(n[True], a, b, c) - log_p(n[False], a, b, c)
            a, b = b, c
        return total / len(cs)

    scores = {p: score(p) for p in urls}
    held = [(math.floor(scores[p] / 0.01), ok) for p, ok in label.items() if aside[p]]
    yes, no = sum(ok for _, ok in held), sum(not ok for _, ok in held)
    gain = {b: sum(not ok for x, ok in held if x < b) / no - sum(ok for x, ok in held if x < b) / yes for b, _ in held}
    threshold = max(gain, key=lambda b: (gain[b], -abs(b * 0.01))) * 0.01
    for r in QUERIES["op2_url_language_model"](spark, SF_CHECK).collect():
        host, path = urls[r.page_id]
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert abs(r.score - scores[r.page_id]) < 2e-6
        if rule or abs(scores[r.page_id] - threshold) > 1e-6:
            assert r.verdict == (verdict or ("allow" if scores[r.page_id] >= threshold else "block"))
    # Rules train the models, so the models mostly agree with them.
    right = [(scores[p] >= threshold) == ok for p, ok in label.items()]
    assert sum(right) / len(right) > 0.85


def test_odd_urls(spark):
    rows = [
        (1, None, ""), (2, "", ""), (3, "no scheme/net/", ""), (4, "HTTP://A.NET", ""), (5, "http://A.Net/x?y://b.org/fr/", ""),
        (6, "http://xnet/a", ""), (7, "http://Example.NET/en/1", ""), (8, "http://a\nb.net/\nq", ""), (9, "http://É.NET/É", ""), (9, "http://É.NET/É", ""),
        (10, "x" * 50_000 + "://h.org/fr/", ""),
    ]
    pages = with_clashes(spark.createDataFrame(rows, PAGES))
    got = judge_urls(pages, "url", URL_RULES, REJECT_WORDS).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = split_url(r.url)
        assert (r.host, r.path, (r.rule, r.verdict if r.rule else None)) == (host, path, rule_of(host, path))
        assert r.verdict in ("allow", "block")
    assert judge_urls(spark.createDataFrame([], PAGES), "url", URL_RULES).count() == 0


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_of(text):
    w = LICENSE_WORD.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES:
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def labels_of(text):
    """Rules one by one, and suppression by comparing all detections of a text."""
    norm = " " + " ".join(LICENSE_WORD.findall((text or "").translate(LOWER))) + " "
    found = []
    for rank, priority, label, keywords, regex in license_scan.rules():
        if any(k in norm for k in keywords):
            found += [(m.start(), -m.end(), priority, rank, label) for m in rx.finditer(regex, norm)]
    found.sort()
    kept = {
        label for i, (start, end, priority, rank, label) in enumerate(found)
        if label and not any(-e >= -end and p <= priority for s, e, p, k, _ in found[:i])
    }
    return kept


TEXTS = [
    "", None, "Released under the MIT license.", "under_the_MIT-LICENSE under the mit license under the mit license", "CC-BY-NC 4.0", "CC BY-NC-SA 4.0",
    "Apache License, Version 2.0", "SPDX-License-Identifier: GPL-2.0-only", "licensed under the GNU General Public License version 3 or any later version",
    "this is not a contract; cc by the way", "mit license, bsd 3-clause license, MPL 2.0", "All rights reserved.", "under the terms of the Mozilla Public License 2.0",
    "écc by nc", "ünder the mit license", "Licensed under the Apache License 2.0 and distributed under the Eclipse Public License 2.0", "word " * 30_000 + "under the mit license",
    "der mit dem mit " * 3_000 + "license mit license mit license, not licensed under mit",
]


def test_licenses_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] * 2
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = scan_licenses(with_clashes(docs(spark, rows + real))).collect()
    assert len(got) == len(rows + real)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(r.text), r.text
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == labels_of(r.text) | base, r.text
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


NAMES = (
    "MIT;MIT-0;Apache2;apache software license 2.0;Apache 1.1;apache 1.0;FreeBSD;2-clause BSD;new BSD;original bsd;0BSD;ISC;GPL1;GNU GPLv2;"
    "gpl-2.0 or later;GPL3;GNU General Public License 3 or any later;library general public license 2;lgpl2.1;lesser general public license 3;"
    "AGPL3;affero general public license 3;MPL1.1;mpl2;MPL-2.0;mozilla public license 2;eclipse public license 1.0;eclipse public license2;CDDL1;"
    "EUPL1.2;artistic 2;artistic 1.0;boost software 1.0;zlib/libpng;Unlicense;WTFPL;CC0;CC BY 4.0;Creative Commons Attribution 4.0;"
    "creative commons attribution ShareAlike 4.0;cc attribution share-alike;creative commons attribution NoDerivs;"
    "Creative Commons Attribution NonCommercial;creative commons attribution non-commercial share alike;"
    "Creative Commons Attribution NonCommercial NoDerivatives;ODbL;SIL Open Font;python software foundation;University of Illinois NCSA;all rights reserved"
).split(";")
FORMS = (
    "the code is {} here", "SPDX-License-Identifier: {}", "licensed under {}", "released under the {}", "distributed under the terms of {}",
    "subject to the {}", "governed by {}", "covered by the {}", "use under {} licence", "license: {}", "the {} license", "under 3 people {}",
)


def test_no_keyword_or_gate_drops_a_license(spark):
    """All rules without keywords or gate on each name in each way."""
    texts = [form.format(name) for name in NAMES for form in FORMS]
    got = {r.text: set(filter(None, r.labels.split(","))) for r in scan_licenses(docs(spark, list(enumerate(texts)))).collect()}
    rules = [(p, k, label, rx.compile(regex)) for k, p, label, _, regex in license_scan.rules()]
    for text in texts:
        norm = " " + " ".join(LICENSE_WORD.findall(text.translate(LOWER))) + " "
        found = sorted((m.start(), -m.end(), p, k, label) for p, k, label, regex in rules for m in regex.finditer(norm))
        kept = {x[4] for i, x in enumerate(found) if x[4] and not any(y[1] <= x[1] and y[2] <= x[2] for y in found[:i])}
        assert got[text] == kept | set(filter(None, base_of(text)[4].split(","))), text


FSF = "{} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
BY_HAND = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated files", "mit"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", "bsd"),
    ("Neither the name of the Example Institute nor the names of its contributors may be used to endorse or promote products", "bsd-3"),
    ("you can modify it under the terms of the " + FSF.format("GNU General Public License", 3), "gpl-3+"),
    (FSF.format("GNU Lesser General Public License", "2.1"), "lgpl-2.1"), (FSF.format("GNU Affero General Public License", 3), "agpl-3"),
    ("released under the GPL", "gpl"), ("BSD licensed", "bsd"), ("MIT-licensed code", "mit"), ("under the terms of the BSD license", "bsd"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"), ("SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-2.0-only", "bsd-3,gpl-2,mit"),
    ("this is not under the gpl 2 license", ""), ("never released under the MIT license", ""), ("not under gpl 2 but released under the isc license", "isc"),
    ("you may not use this file except in compliance with the License", "apache-2"), ("see http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"), ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("he goes mit dem Hund under the tree", ""), ("redistribution of wealth and use of land", ""),
]


def test_labels_given_by_hand(spark):
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(docs(spark, [(i, t) for i, (t, _) in enumerate(BY_HAND)])).collect()}
    for i, (text, labels) in enumerate(BY_HAND):
        # Base phrases stay whatever a denial says.
        want = set(filter(None, labels.split(","))) | set(filter(None, base_of(text)[4].split(",")))
        assert got[i][0] == ",".join(sorted(want)) and (got[i][1] > 0) == bool(want), text
        assert labels_of(text) | set(filter(None, base_of(text)[4].split(","))) == want, text


def test_words_are_counted_between_separators(spark):
    every = [chr(c) for c in (*range(1, 128), 0, 128, 0xA0, 0xE9, 0x2028, 0x1F600)]
    texts = ["", " ", " a", "a ", " a b ", "a", "--", None, *[f"a{c}b" for c in every], *every, *[f"{c}{c}a{c}" for c in every]]
    got = {r.doc_id: r.n_words for r in scan_licenses(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == [base_of(t)[0] for t in texts]


def test_rules_number_hundreds():
    made = license_scan.rules()
    assert len(made) > 250 and all(rx.compile(regex) for *_, regex in made)


def filled(sizes, weights, total, cap):
    """Excess is shared again by weight until no source is over its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = total * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        weight = sum(w[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else left * w[s] / weight for s in order}
        over = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, None: 5000, "d": 0}, {"z": 10}, {"a": 0, None: 0}, {"é": 7, "z": 900, "B": 30, "b": 31},
])
def test_targets_equal_repeated_sharing(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["__source"]: r.target for r in source_targets(df, "source", "size").collect()}
    want = filled(sizes, (5, 2, 1), 1.5, 2.0) if any(sizes.values()) else {s: 0 for s in sizes}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, prose(i, 20 + i % 7), "en", ["big", "mid", "small"][min(i % 10, 2)]) for i in range(3000)]
    df = docs(spark, rows)
    out = mix(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, mix(df.repartition(5)).collect()))
    sizes, taken = Counter(), Counter()
    for r in df.collect():
        sizes[r.source] += len(words(r.text))
    for r in out.collect():
        taken[r.source] += len(words(r.text))
    for s, target in filled(dict(sizes), (5, 2, 1), 1.5, 2.0).items():
        assert abs(taken[s] - target) < 0.06 * target
    assert max(Counter(r.doc_id for r in out.collect()).values()) <= 2


def test_mix_of_odd_rows(spark):
    df = with_clashes(docs(spark, odd_rows()))
    assert mix(df).columns == df.columns
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mix(docs(spark, [(1, None), (2, "")])).count() == 0
