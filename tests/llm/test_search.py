"""Ranked search, top products and phrases beside plain Python, and on odd input."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reefpulse.llm import block_topk, collocations as phrases, mask_search
from reefpulse.llm.block_topk import top_products
from reefpulse.llm.collocations import HatTrie, collocations, phrase_counts
from reefpulse.llm.mask_search import ranked_search
from tests.llm.small import LOWER, docs, odd_rows, with_clashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def expected_ranks(rows, items, k):
    terms = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in rows]
    terms = [(d, Counter(w), len(w)) for d, w in terms if w]
    n_docs, n_terms = len(terms), sum(n for _, _, n in terms)
    df = Counter(w for _, c, _ in terms for w in c)
    out = []
    for item, text in items:
        asked = set(TERM.findall((text or "").translate(LOWER)))
        found = []
        for d, c, n in terms:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2.0 * n_docs + 2.0) / (2.0 * df[w] + 1.0))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m))
                for w in asked if w in c
            )
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def _texts(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "ñu", "x_y", "A9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(d, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 80])))) for d in range(n)]


@pytest.mark.parametrize("k, block, step", [(3, 40, 8), (10, 8192, 256), (500, 64, 1)])
def test_ranks_equal_brute_force(spark, monkeypatch, k, block, step):
    monkeypatch.setattr(mask_search, "BLOCK", block)
    monkeypatch.setattr(mask_search, "STEP", step)
    monkeypatch.setattr(mask_search, "WINDOW", 20)
    rows = _texts(1, 400) + [(d + 1000, t) for d, t in _texts(1, 60)] + [(r[0], r[1]) for r in odd_rows()]
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(70)}" for _ in range(n))) for i, n in enumerate([1, 2, 6, 20, 200])] + [(90, None), (91, ""), (92, "zz qq"), (93, "W0 w0, É!")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for per in (1000, 2):
        got = ranked_search(with_clashes(docs(spark, rows)), with_clashes(table), k=k, block=per)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == expected_ranks(rows, items, k)


def test_ranks_of_empty_and_repeated_tables(spark):
    rows, table = docs(spark, _texts(3, 30)), spark.createDataFrame([(1, "w0 w1"), (1, "w0 w1"), (1, "w2"), (None, "w3")], "item_id long, text string")
    per = {r.item_id: r.n for r in ranked_search(rows, table, k=1).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per == {1: 2, None: 1}
    assert ranked_search(rows.limit(0), table).count() == 0 and ranked_search(rows, table.limit(0)).count() == 0


def test_groups_are_skipped_once_they_cannot_reach():
    rng = np.random.default_rng(5)
    n, vocabulary = 4000, 12
    held = [np.flatnonzero(rng.random(vocabulary) < 0.3) for _ in range(n)]
    lists = pa.array([h.tolist() for h in held], pa.list_(pa.int32()))
    counts = pa.array([[1] * len(h) for h in held], pa.list_(pa.int64()))
    rows = pa.table({"doc": pa.array(range(n)), "n": pa.array([50] * n, pa.int64()), "words": lists, "counts": counts})
    block = mask_search.Block(rows, mask_search.Scoring(n, 50 * n), vocabulary)
    item = mask_search.Item(list(range(vocabulary)), [100 * (i + 1) for i in range(vocabulary)])
    docs_, scores, bar, scored = block.best(item, 50, np.zeros(0, np.int64))
    every = block.scores(item, np.arange(n))
    want = np.lexsort((np.arange(n), -every))[:50]
    assert docs_.tolist() == want.tolist() and scores.tolist() == every[want].tolist() and scored < n / 4
    groups = block.groups(item)
    masks = {tuple(h.tolist()) for h in held if len(h)}
    assert len(groups[2]) == len(masks) and (np.diff(groups[2]) <= 0).all()


def expected_products(rows, k, scale=64):
    vectors = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(vectors):
        if q is None or q % 20:
            continue
        most = (1 << 63) - 1
        found = [(-max(-most, min(most, sum(x * y for x, y in zip(v, w)))), c is None, c or 0) for b, (c, w) in enumerate(vectors) if b != a]
        out += [(q, r, None if none else c, -s) for r, (s, none, c) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_range, per_block, cell, pending", [(8192, 128, 1024, 1 << 20), (60, 7, 3, 40), (25, 1, 1, 1)])
def test_products_equal_brute_force(spark, monkeypatch, per_range, per_block, cell, pending):
    for name, value in (("PER_RANGE", per_range), ("PER_BLOCK", per_block), ("CELL", cell), ("PENDING", pending)):
        monkeypatch.setattr(block_topk, name, value)
    rng = random.Random(7)
    rows = [(i, [rng.gauss(m, 0.2) for m in ((1, 0, 0), (0, -1, 0.5), (0, 0, 0))[i % 3]]) for i in range(150)]
    rows += [(500 + i, [0.5, 0.25, -1.0]) for i in range(30)] + [(20, [0.5, 0.25, -1.0])] * 2
    rows += [(40, None), (60, [1.0, None, 0.0]), (80, [math.nan, 0.0, 0.0]), (100, [1.0, math.inf, 0.0]), (None, [1.0, 1.0, 1.0]), (None, [9.0, 9.0, 9.0]), (120, []), (140, [2.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int").repartition(5)
    got = top_products(with_clashes(table), F.col("id") % 20 == 0, k=6)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected_products(rows, 6)


def test_products_of_large_values_and_few_rows(spark):
    rows = [(0, [1e15, 3.0]), (20, [1e15, -7.0]), (3, [-1e15, 1.0]), (4, [2.0**40, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_products(table, F.col("id") % 20 == 0, k=20).collect()))
    assert got == sorted(expected_products(rows, 20))
    assert top_products(table.limit(0), F.col("id") % 20 == 0).count() == 0


def expected_phrases(rows, words, least, percent, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, words + 1):
                f.update((lang or "und", *w[i : i + size]) for i in range(len(w) - size + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    held = {}
    for (lang, *w), a in cand.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (lang, *w[i : i + size])
                held[part] = max(held.get(part, 0), a)
    out = {}
    for p, a in cand.items():
        if 100 * held.get(p, 0) >= percent * a:
            continue
        lang, w = p[0], p[1:]
        score, k = min(((1_000_000 * a * a) // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted(
        (lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, x, y) in enumerate(sorted(rows)[:most], 1)
    )


def _sentences(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "a b", "é", "\x1cz", "in", "x"]
    for k in range(n):
        parts = [rng.choices(words, [9, 7, 4, 4, 3, 2, 2, 1, 5, 3], k=rng.randrange(1, 9)) for _ in range(rng.randrange(1, 6))]
        yield k, "".join(" ".join(p) + rng.choice([". ", ", ", "\n", "\t", "! ", "\x0b", " "]) for p in parts)


SMALL_LIMITS = {"BURST": 4, "LIMIT": 30, "VOCABULARY": 6, "WINDOW": 40}


@pytest.mark.parametrize("limits, words, least", [({}, 3, 10), (SMALL_LIMITS, 4, 3), (SMALL_LIMITS, 2, 1)])
def test_phrases_equal_brute_force(spark, limits, words, least):
    rows = [(k, t, ("en", "de", None, "und")[k % 4], "s") for k, t in _sentences(11, 240)] + odd_rows()
    # Tasks run in other processes, so the limits travel with the functions.
    made = phrases._runs

    def limited(n, known):
        inner = made(n, known)

        def run(batches):
            from reefpulse.llm import collocations as module

            for name, value in limits.items():
                setattr(module, name, value)
            yield from inner(batches)

        return run

    phrases._runs = limited
    try:
        got = collocations(with_clashes(docs(spark, rows)), words=words, least=least, most=40)
        found = sorted(map(tuple, got.collect()))
    finally:
        phrases._runs = made
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found == expected_phrases([(t, lang) for _, t, lang, *_ in rows], words, least, 50, 40)


def test_phrases_of_an_empty_table(spark):
    assert collocations(docs(spark, []).limit(0)).count() == 0


def test_trie_bursts_and_spills_whole_subtrees(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 5)
    rng = np.random.default_rng(3)
    trie, want = HatTrie(3, 20), Counter()
    for _ in range(20):
        keys, counts = np.unique((rng.integers(0, 3, 200) << 40) | (rng.integers(0, 4, 200) << 20) | rng.integers(0, 200, 200), return_counts=True)
        trie.add(keys, counts)
        want.update(dict(zip(keys.tolist(), counts.tolist())))
    assert any(isinstance(x, list) for x in trie.root) and trie.size == len(want)
    got = Counter()
    for left in (len(want) // 2, 0):
        for keys, counts in trie.spill(left):
            assert not set(got) & set(keys.tolist())
            got.update(dict(zip(keys.tolist(), counts.tolist())))
        assert trie.size <= left
    assert got == want


def test_counts_of_one_length(spark):
    texts = spark.createDataFrame([("en", "a b a b. a b"), ("de", "a b")], "lang string, text string")
    assert sorted(map(tuple, phrase_counts(texts, 2).collect())) == [("de", "a b", 1), ("en", "a b", 3), ("en", "b a", 1)]
