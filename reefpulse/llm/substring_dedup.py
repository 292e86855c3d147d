"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``length`` consecutive words, the ``seed``-word
gram with the least hash (the last one of equals) is an anchor, so two equal
stretches of ``length`` words always share an anchor at the same place, and an
anchor owns the windows of ``length`` words for which it is the least. Anchors of
all documents meet by hash. Extending a seed both ways over its windows gives its
context; occurrences with one context form a class in which all but the first
repeat in full. Only the first of each class, where a seed has several classes, is
compared window by window. Adjacent repeated windows make up a maximal repeat.

Hot passages: occurrences of one context inside one Arrow batch are settled there,
so a passage sends one row a batch to its task however often it is copied.

Defined results: an empty table gives an empty result; null or empty text has no words and no windows; a document whose
id is null counts as part of one document in front of all others; rows with one
id are one document, of which windows with equal starts do not repeat each other,
so that repeated rows are treated alike; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from reefpulse.llm.store import bounded_batches, stored
from reefpulse.llm.wordhash import Words, chunks, mixed, sliding_least, span_hashes

SEED = 8
_ANCHORS = "a long, c long, d long, fp long, lo int, hi int, dup boolean"
_WINDOWS = "a long, h long, d long, fp long, lo int"


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _anchors_of(words: Words, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Per anchor: text, seed hash, context hash, first and last owned window of the text."""
    h, at = words.hashes, words.gram_starts(length)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    starts = np.arange(len(h) - seed + 1)
    grams = span_hashes(h, starts, starts + seed)
    owner = sliding_least(grams, length - seed + 1)[1][at]
    text = words.text_of(at)
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    b = np.flatnonzero(new)
    lo, hi, own, text = at[b], at[np.append(b[1:], len(at)) - 1], owner[b], text[b]
    context = span_hashes(h, lo, hi + length) ^ mixed((own - lo).astype(np.uint64))
    base = words.offsets[text]
    return text, grams[own], context, lo - base, hi - base


def _find_anchors(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d").to_numpy()
            fp = batch.column("fp").to_numpy()
            parts = []
            for lo, hi in chunks(text := batch.column("text")):
                t, *rest = _anchors_of(Words(text.slice(lo, hi - lo)), length, seed)
                parts.append((t + lo, *rest))
            if not parts:
                continue
            t, a, c, lo, hi = (np.concatenate(x) for x in zip(*parts))
            # The earliest occurrence of each context goes on; later ones in this batch are repeats.
            order = np.lexsort((lo, d[t], c, a))
            t, a, c, lo, hi = (x[order] for x in (t, a, c, lo, hi))
            head = np.ones(len(a), bool)
            head[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            first = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
            dup = (d[t] != d[t[first]]) | (lo != lo[first])
            a = np.where(dup, mixed(a ^ mixed(d[t].astype(np.uint64)) ^ lo.astype(np.uint64)), a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(a)), pa.array(_signed(c)), pa.array(d[t]), pa.array(fp[t]),
                 pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(dup)],
                ["a", "c", "d", "fp", "lo", "hi", "dup"],
            )

    return run


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, fp = batch.column("d").to_numpy(), batch.column("fp").to_numpy()
            reps = batch.column("reps")
            flat, ends = reps.values, np.asarray(reps.offsets)
            seeds, los, his = (flat.field(n).to_numpy() for n in ("a", "lo", "hi"))
            for lo, hi in chunks(text := batch.column("text")):
                words = Words(text.slice(lo, hi - lo))
                part = slice(ends[lo], ends[hi])
                row = np.repeat(np.arange(lo, hi), np.diff(ends[lo : hi + 1]))
                n = his[part] - los[part] + 1
                row, seed = np.repeat(row, n), np.repeat(seeds[part], n)
                start = np.repeat(los[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = start + words.offsets[row - lo]
                h = span_hashes(words.hashes, at, at + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed), pa.array(_signed(h)), pa.array(d[row]), pa.array(fp[row]),
                     pa.array(start.astype(np.int32))],
                    ["a", "h", "d", "fp", "lo"],
                )

    return run


def _later(w: W, *first: str) -> Column:
    """Whether a row's document and start come after those of the first row of its group."""
    head = F.first(F.struct(*first)).over(w)
    return F.struct(*first) > head


def repeated_windows(docs: DataFrame, length: int = 20, seed: int = SEED) -> DataFrame:
    """Windows of ``length`` words that also start earlier: d, fp, lo and hi (first and last start).

    ``docs`` has d (document order), fp (text fingerprint) and text.
    """
    anchors = docs.select("d", "fp", "text").mapInArrow(_find_anchors(length, seed), _ANCHORS)
    by_seed = W.partitionBy("a").orderBy("c", "d", "lo", "fp").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_class = W.partitionBy("a", "c").orderBy("d", "lo", "fp")
    ranked = anchors.select(
        "a", "d", "fp", "lo", "hi",
        (F.col("dup") | _later(by_class, "d", "lo")).alias("repeat"),
        (F.first("c").over(by_seed) != F.last("c").over(by_seed)).alias("several"),
    )
    settled = stored(ranked.where("repeat or several").drop("several"), "seeds")
    reps = settled.where("not repeat").groupBy("d", "fp").agg(F.collect_set(F.struct("a", "lo", "hi")).alias("reps"))
    windows = (
        docs.join(reps, ["d", "fp"]).select("d", "fp", "text", "reps").mapInArrow(_window_hashes(length), _WINDOWS)
        .withColumn("repeat", _later(W.partitionBy("a", "h").orderBy("d", "lo", "fp"), "d", "lo"))
    )
    return settled.where("repeat").select("d", "fp", "lo", "hi").unionByName(
        windows.where("repeat").select("d", "fp", "lo", F.col("lo").alias("hi"))
    )


def _cutter(length: int, layout: bool):
    def cut(text: str | None, starts: np.ndarray | None) -> tuple[str | None, int, int]:
        data = (text or "").encode("utf-8", "surrogatepass")
        if starts is None or not len(starts):
            words = data.split()
            return (text if layout else b" ".join(words).decode("utf-8", "surrogatepass")), len(words), 0
        words = Words(pa.array([text]))
        n = len(words.starts)
        edge = np.zeros(n + 1, np.int64)
        lo, hi = starts[0::2], starts[1::2]
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        if layout:
            drop = np.append(words.starts, len(data))
            parts, at = [], 0
            change = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            for i, j in zip(change[0::2], change[1::2]):
                parts.append(data[at : drop[i]])
                at = drop[j]
            parts.append(data[at:])
            kept = b"".join(parts)
        else:
            kept = b" ".join(data[s:e] for s, e in zip(words.starts[~gone].tolist(), words.ends[~gone].tolist()))
        return kept.decode("utf-8", "surrogatepass"), n, int(gone.sum())

    @pandas_udf("text string, n_words long, n_removed long")
    def apply(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(t, s) for t, s in zip(texts, starts)], columns=["text", "n_words", "n_removed"])

    return apply


def drop_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 20, layout: bool = True, seed: int = SEED
) -> DataFrame:
    """All rows of ``docs`` with a struct ``dedup``: text without repeats, n_words, n_removed.

    A word goes if it lies in a window of ``length`` words that also starts earlier:
    in a smaller document, or earlier in the same one. With ``layout`` the white
    space of what stays is kept; otherwise kept words are joined by one space.
    ``length`` must be greater than ``seed``. A column named dedup is replaced.
    """
    if length <= seed:
        raise ValueError(f"a window of {length} words needs seeds of fewer than {seed} words")
    bounded_batches(docs.sparkSession)
    key = {
        "__llm_d": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))),
        "__llm_fp": F.coalesce(F.xxhash64(F.col(text)), F.lit(0).cast("long")),
    }
    texts = docs.withColumns(key)
    spans = repeated_windows(
        texts.select(F.col("__llm_d").alias("d"), F.col("__llm_fp").alias("fp"), F.col(text).alias("text")), length, seed
    )
    spans = spans.groupBy(F.col("d").alias("__llm_d"), F.col("fp").alias("__llm_fp")).agg(
        F.flatten(F.collect_set(F.array("lo", "hi"))).alias("__llm_starts")
    )
    joined = texts.join(spans, list(key), "left")
    return joined.withColumn("dedup", _cutter(length, layout)(text, "__llm_starts")).drop(*key, "__llm_starts")
