"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An item's seeds are, from each of its words on, the shortest gram of 3, 5 or 8 words
that is expected at most ``chance`` times in the corpus, given how often its words
occur in all documents. Seeds meet the grams of every document by hash; hits on
neighbouring diagonals make one window, which is aligned with the whole item by
words (2 a match, -1 a mismatch or gap). The score is that of the best local
alignment as a share of the item's score with itself.

The benchmark is the stated query set: it is read in blocks of at most ``block``
items, each sent to the tasks as it is, and every block meets every document in one
map without a shuffle. A document's cost depends on its length and hits alone, so
neither hot passages nor hot items need splitting.

Defined results: an empty table gives an empty result; null or empty texts and items match nothing; items of fewer than
three words are their own seed; repeated documents or items each give their rows;
words are compared with A to Z lower-cased; rows are dropped one by one, never by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from reefpulse.llm.store import bounded_batches
from reefpulse.llm.wordhash import Words, chunks, span_hashes

SIZES = (3, 5, 8)
MATCH, MISS, GAP = 2, -1, -1
_BITS = 20
# Cells of one batch of alignments.
_CELLS = 1 << 21


class Seeds:
    """Seeds of a block of items, as sorted hashes with the places they come from."""

    def __init__(self, words: Words, log_p: np.ndarray, total: float, chance: float):
        self.hashes, self.offsets = words.hashes, words.offsets
        n_words = len(self.hashes)
        left = np.repeat(self.offsets[1:], words.counts) - np.arange(n_words)
        reach = np.concatenate(([0.0], np.cumsum(log_p)))
        size = np.zeros(n_words, np.int64)
        for n in reversed(SIZES):
            at = np.flatnonzero(left >= n)
            rare = np.log(max(total, 1.0)) + reach[at + n] - reach[at] <= np.log(chance)
            size[at[rare | (n == SIZES[-1])]] = n
        # Items without a rare gram of these sizes, or too short for one: the longest gram there is.
        seeded = np.add.reduceat(np.append(size, 0), self.offsets[:-1]) if n_words else np.zeros(0)
        for item in np.flatnonzero((words.counts > 0) & (seeded == 0)):
            lo, hi = self.offsets[item], self.offsets[item + 1]
            n = max([s for s in SIZES if s <= hi - lo], default=hi - lo)
            size[lo : hi - n + 1] = n
        at = np.flatnonzero(size)
        self.sizes = np.unique(size[at])
        self.tables = {}
        for n in self.sizes.tolist():
            here = at[size[at] == n]
            h = span_hashes(self.hashes, here, here + n)
            order = np.argsort(h, kind="stable")
            h, here = h[order], here[order]
            mask = np.zeros(1 << _BITS, bool)
            mask[h >> np.uint64(64 - _BITS)] = True
            self.tables[n] = (h, here, mask)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word indexes of the documents and of the items at which a seed occurs in both."""
        found_doc, found_item = [], []
        for n, (h, here, mask) in self.tables.items():
            at = words.gram_starts(n)
            g = span_hashes(words.hashes, at, at + n)
            some = mask[g >> np.uint64(64 - _BITS)]
            at, g = at[some], g[some]
            lo, hi = np.searchsorted(h, g), np.searchsorted(h, g, side="right")
            many = hi - lo
            found_doc.append(np.repeat(at, many))
            rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found_item.append(here[np.repeat(lo, many) + rank])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(found_doc or none), np.concatenate(found_item or none)


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each item against its window, and the window index at which it ends.

    One row of the alignment matrix a step, for all pairs at once; gaps along the row
    come from a running maximum.
    """
    rows, cols = max(map(len, items)), max(map(len, windows))
    a = np.zeros((len(items), rows), np.uint64)
    b = np.zeros((len(items), cols), np.uint64)
    a_real, b_real = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for k, (x, y) in enumerate(zip(items, windows)):
        a[k, : len(x)], a_real[k, : len(x)], b[k, : len(y)], b_real[k, : len(y)] = x, True, y, True
    h = np.zeros((len(items), cols + 1), np.int32)
    ramp = np.arange(cols + 1, dtype=np.int32) * -GAP
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(rows):
        same = (b == a[:, i : i + 1]) & b_real & a_real[:, i : i + 1]
        t = np.maximum(h + GAP, 0)
        t[:, 1:] = np.maximum(t[:, 1:], h[:, :-1] + np.where(same, MATCH, MISS))
        h = np.maximum.accumulate(t + ramp, axis=1) - ramp
        top = h.argmax(axis=1)
        value = h[np.arange(len(h)), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top - 1, end)
    return best, end


def _batched(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``align`` in batches of windows of like length."""
    score, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order = np.argsort([len(w) for w in windows], kind="stable")
    at = 0
    while at < len(order):
        take, width = at + 1, len(windows[order[at]])
        while take < len(order) and (take - at + 1) * max(width, len(windows[order[take]])) <= _CELLS // 8:
            width = len(windows[order[take]])
            take += 1
        part = order[at:take]
        score[part], end[part] = align([items[k] for k in part], [windows[k] for k in part])
        at = take
    return score, end


def _windows(seeds: Seeds, words: Words) -> tuple[np.ndarray, ...]:
    """Per candidate: text, item, and the first word and the end of the window in the chunk."""
    doc_at, item_at = seeds.hits(words)
    text = words.text_of(doc_at)
    item = np.searchsorted(seeds.offsets, item_at, side="right") - 1
    shift = (doc_at - words.offsets[text]) - (item_at - seeds.offsets[item])
    order = np.lexsort((shift, item, text))
    text, item, shift = text[order], item[order], shift[order]
    length = np.diff(seeds.offsets)[item]
    slack = np.maximum(4, length // 3)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > slack[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1 if len(first) else first
    text, item, length, slack = text[first], item[first], length[first], slack[first]
    lo = words.offsets[text] + np.maximum(shift[first] - slack, 0)
    hi = np.minimum(words.offsets[text] + shift[last] + length + slack, words.offsets[text + 1])
    return text, item, lo, hi


def _matches(seeds: Seeds, item_ids: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.diff(seeds.offsets)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for at, to in chunks(column := batch.column("text")):
                words = Words(column.slice(at, to - at), lower=True)
                text, item, lo, hi = _windows(seeds, words)
                if not len(text):
                    continue
                wanted = [seeds.hashes[seeds.offsets[i] : seeds.offsets[i + 1]] for i in item]
                windows = [words.hashes[a:b] for a, b in zip(lo, hi)]
                score, end = _batched(wanted, windows)
                share = score / (MATCH * lengths[item])
                good = np.flatnonzero(share >= least)
                # The best window of each text and item.
                good = good[np.lexsort((lo[good], -share[good], item[good], text[good]))]
                head = np.ones(len(good), bool)
                head[1:] = (text[good][1:] != text[good][:-1]) | (item[good][1:] != item[good][:-1])
                good = good[head]
                if not len(good):
                    continue
                back = _batched([wanted[k][::-1] for k in good], [windows[k][: end[k] + 1][::-1] for k in good])[1]
                base = words.offsets[text[good]]
                last = lo[good] + end[good]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(text[good] + at)), pa.array(item_ids[item[good]], pa.int64(), from_pandas=True),
                     pa.array(share[good]), pa.array(last - back - base), pa.array(last - base)],
                    ["id", "item", "score", "first_word", "last_word"],
                )

    return run


def _holds(seeds: Seeds, item_ids: np.ndarray, least: float):
    """Whether each text holds a passage of the block."""
    matches = _matches(seeds, item_ids, least)

    def run(texts: pa.Array) -> pa.Array:
        held = np.zeros(len(texts), bool)
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], ["id", "text"])
        for found in matches(iter([batch])):
            held[found.column("id").to_numpy()] = True
        return pa.array(held)

    return run


def _occurrences(vocabulary: np.ndarray):
    """How often each word of the sorted vocabulary occurs; the last row counts all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocabulary) + 1, np.int64)
        mask = np.zeros(1 << _BITS, bool)
        mask[vocabulary >> np.uint64(64 - _BITS)] = True
        for batch in batches:
            for lo, hi in chunks(column := batch.column("text")):
                h = Words(column.slice(lo, hi - lo), lower=True).hashes
                n[-1] += len(h)
                h = h[mask[h >> np.uint64(64 - _BITS)]]
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                n[:-1] += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["word", "n"])

    return run


def _blocks(
    texts: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, chance: float, block: int
) -> Iterator[tuple[Seeds, np.ndarray]]:
    """Seeds and item ids of each block of the benchmark; words are counted in ``texts`` (text)."""
    bounded_batches(texts.sparkSession)
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    blocks = -(-items.count() // block)
    part = F.pmod(F.xxhash64("text"), F.lit(max(blocks, 1)))
    for b in range(max(blocks, 1)):
        here = items.where(part == b).toPandas()
        words = Words(pa.array(here["text"].tolist(), pa.string()), lower=True)
        if len(words.hashes):
            vocabulary, which = np.unique(words.hashes, return_inverse=True)
            counted = texts.mapInArrow(_occurrences(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
            counted = counted.toPandas()
            n = np.zeros(len(vocabulary) + 1)
            n[counted["word"].to_numpy(np.int64)] = counted["n"].to_numpy(np.float64)
            total = max(n[-1], 1.0)
            log_p = np.log(np.maximum(n[:-1], 1.0) / total)[which]
            seeds = Seeds(words, log_p, total, chance)
        else:
            seeds = Seeds(words, np.zeros(0), 1.0, chance)
        yield seeds, here["item"].to_numpy()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", least: float = 0.5, chance: float = 1.0, block: int = 20_000,
) -> DataFrame:
    """One row per document and item whose best alignment scores ``least`` or more.

    doc_id, item_id, score, and the first and last word of the passage (from 0).
    """
    known = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    out = None
    for seeds, item_ids in _blocks(known.select("text"), benchmark, item_id, item_text, chance, block):
        found = known.mapInArrow(_matches(seeds, item_ids, least), "id long, item long, score double, first_word long, last_word long")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "score", "first_word", "last_word")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    least: float = 0.5, chance: float = 1.0, block: int = 20_000,
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage: judged row by row, whatever their ids."""
    clean = F.lit(True)
    for seeds, item_ids in _blocks(docs.select(F.col(text).alias("text")), benchmark, item_id, item_text, chance, block):
        clean = clean & ~arrow_udf(_holds(seeds, item_ids, least), "boolean")(F.col(text))
    return docs.where(clean)
