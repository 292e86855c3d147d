"""Substring dedup and near duplicates beside plain Python."""

from __future__ import annotations

import pytest

from reefpulse.llm.components import components
from reefpulse.llm.minhash import drop_near_duplicates, near_duplicates
from reefpulse.llm.substring_dedup import drop_repeats
from tests.llm.small import DOCS, LOWER, docs, odd_rows, prose, with_clashes, words


def expected_cut(rows, length):
    """Kept words by (doc_id, text): rows of one id are one document with separate starts."""
    first = {}
    for d, text in rows:
        w = words(text)
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            at = (d is not None, d or 0, s)
            first[key] = min(first.get(key, at), at)
    out = {}
    for d, text in rows:
        w = words(text)
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (d is not None, d or 0, s):
                gone.update(range(s, s + length))
        out[(d, text)] = [x for i, x in enumerate(w) if i not in gone]
    return out


@pytest.mark.parametrize("length", [9, 20, 50])
def test_cut_equals_brute_force(spark, length):
    base = prose(3, 200).split()
    rows = [(d, " ".join(prose(d, 40).split() + base[d * 5 : d * 5 + 60] + prose(d + 50, 30).split())) for d in range(12)]
    rows += [(20, " ".join(["x"] * 100)), (21, " ".join(base + base)), (22, "\n".join(base[:55]) + "  end"), (23, prose(8, length - 1)), (24, prose(8, length))]
    rows += [(r[0], r[1]) for r in odd_rows()]
    want = expected_cut(rows, length)
    for layout in (False, True):
        got = drop_repeats(docs(spark, [(*r,) for r in rows]), length=length, layout=layout).collect()
        assert len(got) == len(rows)
        for r in got:
            kept = want[(r.doc_id, r.text)]
            assert words(r.dedup.text) == kept
            assert (r.dedup.n_words, r.dedup.n_removed) == (len(words(r.text)), len(words(r.text)) - len(kept))


def test_layout_of_what_stays(spark):
    passage = prose(5, 60)
    rows = [(1, passage), (2, f"Start here\n\n{passage}\nand  end")]
    got = {r.doc_id: r.dedup.text for r in drop_repeats(docs(spark, rows), length=50).collect()}
    assert got == {1: passage, 2: "Start here\n\nand  end"}


def test_many_copies_of_a_passage(spark):
    passage = prose(6, 30)
    rows = [(d, f"{prose(d + 100, 12)} {passage} {prose(d + 900, 12)}") for d in range(400)]
    got = drop_repeats(docs(spark, rows), length=20).groupBy("dedup.n_removed").count().collect()
    assert {tuple(r) for r in got} == {(0, 1), (30, 399)}


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], DOCS)
    assert drop_repeats(none).count() == near_duplicates(none).count() == drop_near_duplicates(none).count() == 0
    df = with_clashes(docs(spark, odd_rows()))
    assert drop_repeats(df).drop("dedup").columns == df.columns
    assert drop_near_duplicates(df).columns == df.columns
    with pytest.raises(ValueError):
        drop_repeats(df, length=5)


def expected_near(rows, k, percent):
    sets = []
    for d, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    lead = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            lead[find(i)] = min(lead.get(find(i), d), d)
    return sorted(((d, len(sets[i]), lead.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def edited(text, every, start=0):
    return " ".join("zz" + w if i % every == start else w for i, w in enumerate(text.split()))


@pytest.mark.parametrize("k", [1, 2, 5])
def test_components_equal_brute_force(spark, k):
    base = prose(11, 300)
    rows = [(d, edited(base, 30 + d, d % 7)) for d in range(10)]
    # A chain: each a little further from the first.
    chain = prose(12, 120).split()
    rows += [(20 + d, " ".join(chain[3 * d : 3 * d + 90])) for d in range(8)]
    rows += [(40, "a b"), (41, "A B"), (42, "a"), (43, "b"), (44, "a b c")] + [(r[0], r[1]) for r in odd_rows()]
    got = near_duplicates(docs(spark, rows), shingle=k).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == expected_near(rows, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_threshold_is_exact(spark):
    same = [f"s{i}" for i in range(80)]
    at = same + [f"a{i}" for i in range(10)], same + [f"b{i}" for i in range(10)]
    under = same + [f"c{i}" for i in range(10)], same + [f"e{i}" for i in range(11)]
    rows = [(1, " ".join(at[0])), (2, " ".join(at[1])), (3, " ".join("q" + w for w in under[0])), (4, " ".join("q" + w for w in under[1]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, rows), shingle=1).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_hot_group_of_near_copies_needs_few_pairs(spark):
    base = prose(13, 200)
    rows = [(d, edited(base, 190, d % 190) + f" n{d}") for d in range(1, 600)]
    got = near_duplicates(docs(spark, rows), shingle=2).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [1]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (7, 7), (201, 200)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200}
    assert components(links.where("u < 0")).count() == 0


def test_texts_without_id_whose_short_hashes_agree(spark):
    """200,000 texts without id, of which some pairs agree in 32 bits, keep words of their own."""
    from pyspark.sql import functions as F

    tail, many = " ".join(["t"] * 30), 200_000
    head = F.concat_ws(" ", *[F.concat(F.lit(f"h{k}x"), F.col("id").cast("string")) for k in range(3)])
    texts = spark.range(many).select(
        F.lit(None).cast("long").alias("doc_id"), F.concat(head, F.when(F.col("id") % 2 == 0, F.lit(" " + tail)).otherwise(F.lit(""))).alias("text")
    )
    got = drop_repeats(texts, length=20)
    short = got.where(F.size(F.split("text", " ")) == 3)
    assert short.where("dedup.n_removed <> 0 or dedup.text <> text").isEmpty() and got.count() == many


def test_rounds_read_only_what_is_apart(spark, monkeypatch):
    from reefpulse.llm import minhash

    seen = []
    monkeypatch.setattr(minhash, "stored", lambda df, label, real=minhash.stored: seen.append((label, out := real(df, label))) or out)
    base = prose(30, 120).split()
    rows = [(d, " ".join(base[:110] + prose(500 + d % 7, 10).split())) for d in range(300)]
    rows += [(1000 + d, " ".join(prose(2000 + d % 60, 40).split() + ["end"] * (d % 2))) for d in range(300)]
    near_duplicates(docs(spark, rows), shingle=2, percent=80).count()
    named = [df.count() for label, df in seen if label == "named"]
    apart = [df.count() for label, df in seen if label == "apart"]
    assert named[1:] == apart[: len(named) - 1]
