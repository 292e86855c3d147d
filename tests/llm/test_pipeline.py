"""The pipeline's stages beside plain Python, each on what the one before it kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from reefpulse.llm.decontaminate import drop_contaminated
from reefpulse.llm.minhash import drop_near_duplicates
from reefpulse.llm.store import stored
from tests.conftest import SF_SMALL
from tests.llm.small import DOCS, docs, odd_rows, prose, words
from tests.llm.test_dedup import expected_cut, expected_near


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_take_and_return_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "source_mix"]
    known = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    passage = prose(7, 70)
    planted = [(90_000 + i, f"{prose(i + 300, 60)}\n{passage} {prose(i + 400, 60)}") for i in range(4)]
    now = known.unionByName(docs(spark, planted))
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stored(stage(spark, now, SF_SMALL), name)
        assert now.dtypes == known.dtypes
        rows, out = pairs(before), pairs(now)
        if name == "quality_rules":
            assert set(out) < set(rows) and all(len(words(t)) >= 50 for _, t in out) and {d for d, _ in planted} <= {d for d, _ in out}
        elif name == "near_dedup":
            want = {d for d, _, lead in expected_near(rows, 5, 80) if d == lead}
            assert {d for d, _ in out} == want and len(out) == len(want)
        elif name == "substring_dedup":
            want = expected_cut(rows, 50)
            assert {d: words(t) for d, t in out} == {d: want[d, t] for d, t in rows}
            assert sum(passage in (t or "") for _, t in out) == 1
            assert all(r.n_chars == len(r.text) for r in now.collect())
        elif name == "decontamination":
            items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
            leaks = {d for d, t in rows if any(i in " ".join(words(t)) for i in items)}
            assert set(out) <= set(rows) and not leaks & {d for d, _ in out} and len(rows) - len(out) <= len(leaks) + 3
        else:
            assert set(out) <= set(rows) and max(Counter(out).values()) <= 2


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 0


def test_odd_and_empty_documents(spark):
    for rows in (odd_rows(), []):
        df = docs(spark, rows) if rows else spark.createDataFrame([], DOCS)
        for _, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, df, SF_SMALL), "odd")
            assert out.dtypes == df.dtypes and (rows or not out.count())


def test_rows_are_dropped_by_text_not_by_id(spark):
    """Unique rows with a null or repeated id beside flagged ones of that id stay; one of a group without ids stays."""
    item, base, other = prose(500, 40), prose(1, 120), prose(2, 120)
    unique = [(None, prose(3, 120)), (None, prose(4, 120)), (9, prose(5, 120))]
    nulls = [(None, other), (None, other + " tail")]
    rows = [(1, base), (None, base + " tail"), (9, base + " end"), *nulls, *unique]
    out = pairs(drop_near_duplicates(docs(spark, rows), shingle=5, percent=80))
    left = [r for r in out if r in nulls]
    assert len(left) == 1 and sorted(out, key=repr) == sorted([(1, base), *left, *unique], key=repr)
    leaks = [(None, f"{prose(6, 60)} {item}"), (9, f"{item} {prose(7, 60)}")]
    bench = spark.createDataFrame([(1, item), (2, prose(501, 40))], "item_id long, text string")
    for block in (20_000, 1):
        out = pairs(drop_contaminated(docs(spark, leaks + unique), bench, block=block))
        assert sorted(out, key=repr) == sorted(unique, key=repr)
