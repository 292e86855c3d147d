"""Quality outliers, language ID and decontamination beside plain Python."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from reefpulse.llm import quality
from reefpulse.llm.decontaminate import align, contaminated, drop_contaminated
from reefpulse.llm.language_id import identify
from reefpulse.llm.queries import QUERIES
from reefpulse.llm.quality import keep_good, measured
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.small import DOCS, LOWER, docs, odd_rows, prose, with_clashes, words


def counts(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


TEXTS = ["a b a b a b", "x\nx\n x\n\n\nx\r\n", "é#*$%&|<> 漢字", "\n", "a a a", "a b c", "one line\none line", "\x1fa\x85b\xa0c"]


def test_counts_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(r[0], r[1]) for r in odd_rows()]
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    for r in measured(with_clashes(docs(spark, rows + real))).collect():
        assert tuple(r.quality) == counts(r.text), r.text


def test_outliers_against_a_dense_fit(spark):
    """Registered verdicts: base rules by brute force, the rest by the same estimate computed in numpy."""
    known = spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op10_robust_outliers"](spark, SF_CHECK).collect()}
    rows = {}
    for d in known:
        n, chars, symbols, lines, dup, repeat = counts(d.text)
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
        share = [np.log(max(chars, 1) / max(n, 1))] + [np.log1p(10 * a / max(b, 1)) for a, b in ((symbols, chars), (dup, lines), (repeat, n))]
        rows[d.doc_id] = (d.lang, d.source, np.floor(1000 * np.array(share) + 0.5), r.base_failed)
    size = Counter((lang, source) for lang, source, _, bad in rows.values() if not bad)
    by_lang = Counter()
    for (lang, source), n in size.items():
        by_lang[lang] += n if n < 50 else 0

    def unit(lang, source):
        return (lang, source) if size[lang, source] >= 50 else (lang,) if by_lang[lang] >= 50 else ()

    rest = sum(n for lang, n in by_lang.items() if n < 50)
    least = np.diag(np.square(quality.LEAST_SCALE))
    groups = {}
    for d, (lang, source, x, bad) in rows.items():
        if not bad:
            groups.setdefault(unit(lang, source), []).append(x)
    model = {}
    for u, xs in groups.items():
        if u == () and rest < 50:
            continue
        x = np.array(xs)
        q = np.percentile(x, [25, 50, 75], axis=0)
        centre, scatter = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2)

        def bins(centre, scatter):
            far = np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(scatter + least), x - centre)
            return np.floor(200 * np.log1p(far))

        for _ in range(3):
            b = bins(centre, scatter)
            part = x[b <= np.percentile(b, 75)]
            centre, scatter = part.mean(axis=0), np.cov(part.T, bias=True)
        grow = max(np.expm1((np.percentile(bins(centre, scatter), 50) + 0.5) / 200) / quality.MEDIAN, 1)
        model[u] = centre, np.linalg.inv(scatter * grow + least)
    off = 0
    for d, (lang, source, x, bad) in rows.items():
        if bad:
            continue
        if unit(lang, source) in model:
            centre, inverse = model[unit(lang, source)]
            far = (x - centre) @ inverse @ (x - centre)
            assert abs(got[d].distance - far) < 0.02 * (1 + far)
            off += got[d].kept != (far <= quality.CUTOFF)
        else:
            assert got[d].distance is None and got[d].kept
    assert off <= 1
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    good = [got[d].kept for d, q in labels.items() if q == 1 and not got[d].base_failed]
    poor = [got[d].kept for d, q in labels.items() if q == 0]
    assert sum(good) / len(good) > 0.98 and sum(poor) / len(poor) < 0.1


@pytest.mark.parametrize("percent", [20, 27, 33, 40])
def test_outliers_that_are_a_large_part_of_a_group(spark, percent):
    """Copies of one text with 15% symbols beside distinct clean texts of one language and source."""
    def plain(i):
        return " ".join("x" * (3 + (i + k * k) % 5) + w for k, w in enumerate(prose(i, 60 + i % 40).split()))

    copy = " ".join(w + "#" * (1 + k % 2) for k, w in enumerate(prose(9_000, 80).split()))
    rows = [(i, copy if i % 100 < percent else plain(i)) for i in range(300)]
    got = {r.doc_id for r in keep_good(docs(spark, rows)).collect()}
    assert got == {i for i, t in rows if t != copy}


def test_quality_of_odd_rows(spark):
    df = with_clashes(docs(spark, odd_rows()))
    got = keep_good(df)
    assert got.columns == df.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 0, 5, 5, 6, 8]
    assert keep_good(spark.createDataFrame([], DOCS)).count() == 0


def test_languages_held_out(spark):
    import zlib

    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    right = []
    for r in QUERIES["op5_nearest_centroid"](spark, SF_CHECK).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "es", "und")
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", truth[r.doc_id].text or ""))
        if r.held_out:
            right.append(r.lang_pred == truth[r.doc_id].lang)
    assert sum(right) / len(right) > 0.97


def test_far_texts_are_rejected(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").unionByName(docs(spark, [(10_001, "κατα το δοκουν μου " * 30, None, "s"), (10_002, "zqxj vvkw " * 40, None, "s")]))
    got = {r.doc_id: r.language for r in identify(df).where("doc_id > 10000 or lang = 'de'").collect()}
    assert got[10_001].rejected and got[10_002].rejected
    plain = [x.rejected for d, x in got.items() if d <= 10_000]
    assert sum(plain) / len(plain) < 0.1


def test_languages_of_odd_rows(spark):
    rows = odd_rows() + [(30, "123 !!", None, None), (31, "é", "fr", "s"), (32, "ab", None, "s")]
    got = {r.text: r.language for r in identify(with_clashes(docs(spark, rows))).collect()}
    assert all((got[t].lang, got[t].score) == ("und", 0.0) for t in (None, "", " \t\n ", "123 !!"))
    assert got["é"].lang != "und" and got["ab"].lang != "und"
    nothing = identify(docs(spark, [(1, "text without a language", None, "s")])).collect()[0].language
    assert (nothing.lang, nothing.score, nothing.rejected) == ("und", 0.0, False)
    assert identify(spark.createDataFrame([], DOCS)).count() == 0


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_textbook():
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 6, n).astype(np.uint64) for n in (1, 5, 20, 33)]
    windows = [rng.integers(0, 6, n).astype(np.uint64) for n in (3, 1, 50, 20)]
    score, end = align(items, windows)
    for k, (a, b) in enumerate(zip(items, windows)):
        assert score[k] == smith_waterman(a, b) == (smith_waterman(a, b[: end[k] + 1]) if score[k] else 0)


def test_leaks_equal_all_pairs(spark):
    """Every document against every item by the textbook alignment of whole texts."""
    items = [(i, prose(i + 500, 12 + 3 * i)) for i in range(8)]
    text = dict(items)

    def swapped(i, every):
        return " ".join("other" if k % every == every - 1 else w for k, w in enumerate(text[i].split()))

    rows = [(i, f"{prose(i, 60)} {text[i]} {prose(i + 40, 50)}") for i in range(8)]
    rows += [(20 + i, f"{prose(i, 30)}\n{swapped(i, 5).upper()} {prose(i + 60, 90)}") for i in range(8)]
    rows += [(40 + i, f"{prose(i, 50)} " + " ".join(text[i].split()[: len(text[i].split()) // 3])) for i in range(8)]
    rows += [(60 + i, prose(i + 70, 150)) for i in range(8)]
    want = set()
    for d, t in rows:
        w = [x.translate(LOWER) for x in words(t)]
        for i, item in items:
            v = item.split()
            if set(v) & set(w) and smith_waterman(v, w) >= 0.5 * 2 * len(v):
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 3):
        got = contaminated(docs(spark, [(d, t) for d, t in rows]), bench, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    for r in got:
        passage = words(dict(rows)[r.doc_id])[r.first_word : r.last_word + 1]
        assert set(w.translate(LOWER) for w in passage) & set(text[r.item_id].split())
    assert {r.doc_id for r in drop_contaminated(docs(spark, [(d, t) for d, t in rows]), bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_leaks_of_the_given_tables(spark):
    items = spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()
    texts = spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_benchmark_leaks"](spark, SF_CHECK).collect()}
    exact = {(d.doc_id, i.item_id) for d in texts for i in items if " ".join(words(i.text)) in " ".join(words(d.text))}
    assert exact and exact <= got


def test_leaks_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "tiny"), (None, prose(1, 40)), (5, prose(1, 40)), (5, prose(1, 40))], "item_id long, text string")
    df = with_clashes(docs(spark, odd_rows() + [(50, "a tiny thing")]))
    got = Counter((r.doc_id, r.item_id) for r in contaminated(df, bench).collect())
    assert got == {(50, 3): 1, (None, None): 2, (None, 5): 4, (5, None): 2, (5, 5): 4}
    assert drop_contaminated(df, bench).columns == df.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(df, none).count() == 0 and drop_contaminated(df, none).count() == len(odd_rows()) + 1
    assert contaminated(spark.createDataFrame([], DOCS), bench).count() == 0


@pytest.mark.parametrize("repeat", [300])
def test_a_passage_repeated_in_one_document(spark, repeat):
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    got = contaminated(docs(spark, [(1, " ".join([prose(1, 30)] * repeat))]), bench).collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 1.0)]


def test_nearest_centroid_equals_brute_force(spark):
    """Rows without ids are sampled as others are; predictions are the greatest cosine over all centroids."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from reefpulse.llm.language_id import learn, predicted, vectors

    given = spark.read.parquet(f"{SF_CHECK}/documents.parquet").where("lang is not null and text is not null").select("text", "lang")
    rows = given.withColumn("id", F.lit(None).cast("long"))
    model = learn(rows, sample=30)
    langs, centroids, radius, idf = model
    assert set(langs) == {r.lang for r in given.select("lang").distinct().collect()} and len(centroids) == 3 * len(set(langs))
    got = {r.text: r.p for r in given.select("text", predicted(F.col("text"), model).alias("p")).collect()}
    for text, p in list(got.items())[:200]:
        v = vectors(pa.array([text]), idf)[0].astype(float)
        cos = [float(np.dot(v, c.astype(float))) for c in centroids]
        best = max(range(len(cos)), key=lambda k: cos[k])
        if p.lang != "und":
            assert abs(p.score - min(max(cos[best], 0), 1)) < 1e-4 and cos[langs.index(p.lang) : langs.index(p.lang) + 3]
            assert max(c for c, n in zip(cos, langs) if n == p.lang) > cos[best] - 1e-4
            assert p.rejected == (cos[best] < radius[best]) or abs(cos[best] - radius[best]) < 1e-4
