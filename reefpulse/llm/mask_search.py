"""Ranked lexical search by presence masks.

One pass over the texts turns each document into its length and the counts of those
words that items ask for; that table is written once, and words are counted in documents
from it. The search then reads it in blocks of ``BLOCK`` documents. In a block each word
asked for has a bitmap over the documents. An item's bitmaps, turned about, give each document a mask:
which of the item's words it holds. Documents with one mask form a group, and the most that a
group can score is the sum, over its words, of the weight times the largest impact of the word in
the block. Groups are scored in descending order of that, until the item's k-th score so far, carried from block to block of a
task, is above what the next group can reach. Every task leaves for an item the documents that
beat its bar then, and a ranking over all tasks' documents ends the search.

Items are searched ``items`` at a time (a bound for what the driver collects and tasks hold: words and ids of
a block of items); each block of items takes a pass of its own over texts and table.

Defined results: null and empty texts hold no term, match nothing and do not count; items
without a term that occurs have no rows; an item is a row of the items table by id and text (equal
rows are one item, rows that share an id and differ in text are ranked each by itself); each row of the
documents is a document, also where it repeats; ties go to the smaller id, null last; an empty
table gives an empty result; texts of any length are counted in windows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from reefpulse.llm.store import bounded_batches, stored

BLOCK, WINDOW = 8192, 1 << 20
# Groups of at least so many documents are scored at a time.
STEP = 256

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _windows(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + WINDOW)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(vocabulary: dict[bytes, int]):
    """n, and the numbers and counts of the vocabulary's words, for each text with a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            rows, n, ends, words, counts = [], [], [0], [], []
            for row, text in enumerate(batch.column("text").cast(pa.binary())):
                size, held = 0, Counter()
                for terms in _windows(text.as_py()):
                    size += len(terms)
                    for term, c in Counter(terms).items():
                        if (w := number(term)) is not None:
                            held[w] += c
                if size:
                    rows.append(row)
                    n.append(size)
                    words += held.keys()
                    counts += held.values()
                    ends.append(len(words))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(words, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))],
                ["doc", "n", "words", "counts"],
            )

    return run


class Scoring:
    """Whole-number weights and impacts of a collection of ``docs`` documents and ``terms`` terms."""

    def __init__(self, docs: int, terms: int):
        self.docs, self.terms = docs, terms

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2.0 * self.docs + 2.0) / (2.0 * df + 1.0)))

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What a term that occurs tf times in a document of n terms adds, for a weight of 1."""
        sizes, which = np.unique(n, return_inverse=True)
        m = np.array([50 + 50 * int(x) * self.docs // self.terms for x in sizes], np.int64)[which]
        return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Item:
    """An item's words, by number, and their weights."""

    def __init__(self, words: list[int], weights: list[int]):
        self.words, self.weights = np.array(words, np.int64), np.array(weights, np.int64)


class Block:
    """Documents with their words, in ascending order of id, and a bitmap for each word."""

    def __init__(self, rows: pa.Table, scoring: Scoring, vocabulary: int):
        order = pc.sort_indices(rows.select(["doc"]), sort_keys=[("doc", "ascending")], null_placement="at_end")
        rows = rows.take(order).combine_chunks()
        self.ids, self.size = rows.column("doc"), len(rows)
        lists = rows.column("words").combine_chunks()
        self.length = pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.word = lists.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(self.size), self.length)
        n = rows.column("n").to_numpy()
        self.impact = scoring.impacts(n[doc], rows.column("counts").combine_chunks().flatten().to_numpy())
        present = np.unique(self.word)
        place = np.zeros(vocabulary, np.int64)
        place[present] = np.arange(len(present))
        # One bitmap a word, eight documents a byte, and the largest impact.
        self.bitmaps = np.zeros((len(present), -(-self.size // 8)), np.uint8)
        np.bitwise_or.at(self.bitmaps, (place[self.word], doc >> 3), (128 >> (doc & 7)).astype(np.uint8))
        self.most = np.zeros(len(present), np.int64)
        np.maximum.at(self.most, place[self.word], self.impact)
        self.place, self.held = place, np.zeros(vocabulary, bool)
        self.held[present] = True
        self.weight = np.zeros(vocabulary, np.int64)

    def groups(self, item: Item) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents in order of their groups, where each group begins, and the most it can score; best groups first."""
        here = self.held[item.words]
        at = self.place[item.words[here]]
        if not len(at):
            return (np.zeros(0, np.int64),) * 3
        bits = np.unpackbits(self.bitmaps[at], axis=1)[:, : self.size]
        some = np.flatnonzero(np.bitwise_or.reduce(self.bitmaps[at], axis=0))
        docs = (some[:, None] * 8 + np.arange(8)).ravel()
        docs = docs[docs < self.size]
        docs = docs[bits[:, docs].any(axis=0)]
        packed = np.packbits(bits[:, docs], axis=0).T
        wide = np.zeros((len(docs), -(-packed.shape[1] // 8) * 8), np.uint8)
        wide[:, : packed.shape[1]] = packed
        masks = wide.view(np.uint64)
        order = np.lexsort(masks.T)
        masks, docs = masks[order], docs[order]
        first = np.flatnonzero(np.concatenate(([True], (masks[1:] != masks[:-1]).any(axis=1))))
        # Whole numbers far below 2 ** 53, so doubles hold the sums exactly.
        most = (bits[:, docs[first]].T.astype(float) @ (item.weights[here] * self.most[at]).astype(float)).astype(np.int64)
        by = np.argsort(-most, kind="stable")
        sizes = np.diff(np.concatenate((first, [len(docs)])))[by]
        begin = np.cumsum(sizes) - sizes
        docs = docs[np.repeat(first[by], sizes) + np.arange(len(docs)) - np.repeat(begin, sizes)]
        return docs, np.append(begin, len(docs)), most[by]

    def scores(self, item: Item, docs: np.ndarray) -> np.ndarray:
        self.weight[item.words] = item.weights
        length = self.length[docs]
        at = np.repeat(self.start[docs], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        added = np.concatenate(([0], np.cumsum(self.weight[self.word[at]] * self.impact[at])))
        self.weight[item.words] = 0
        ends = np.cumsum(length)
        return added[ends] - added[ends - length]

    def best(self, item: Item, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Documents that may be of the k best, their scores, the k best scores now, and how many documents were scored.

        ``bar`` has the best scores so far, highest first.
        """
        docs, begin, most = self.groups(item)
        found, scores, g, scored = [], [], 0, 0
        while g < len(most) and (len(bar) < k or most[g] >= bar[-1]):
            to = max(g + 1, int(np.searchsorted(begin, begin[g] + STEP)))
            # A group that cannot reach the bar ends the step, as it ends the search.
            if len(bar) == k:
                to = min(to, max(g + 1, int(np.searchsorted(-most, -bar[-1], side="right"))))
            to = min(to, len(most))
            some = docs[begin[g] : begin[to]]
            got = self.scores(item, some)
            scored += len(some)
            good = (got > 0) & ((got >= bar[-1]) if len(bar) == k else True)
            found.append(some[good])
            scores.append(got[good])
            bar = np.sort(np.concatenate((bar, got[good])))[::-1][:k]
            g = to
        docs, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, scores))
        order = np.lexsort((docs, -scores))[:k]
        order = order[scores[order] >= bar[-1]] if len(bar) == k else order
        return docs[order], scores[order], bar, scored


def _searched(items: list[Item], scoring: Scoring, vocabulary: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars = [np.zeros(0, np.int64)] * len(items)

        def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            here = Block(rows, scoring, vocabulary)
            for i, item in enumerate(items):
                docs, scores, bars[i], _ = here.best(item, k, bars[i])
                if len(docs):
                    ids = here.ids.take(pa.array(docs))
                    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), i)), ids, pa.array(scores)], ["item", "doc", "score"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield from block(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from block(pa.Table.from_batches(held))

    return run


def item_terms(text: str | None) -> list[bytes]:
    """An item's terms, once each."""
    return list(dict.fromkeys(term for terms in _windows((text or "").encode()) for term in terms))


def ranked_search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    k: int = 50, block: int = 1000,
) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` documents that score highest for each item.

    ``block`` items are searched at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("text is not null and text <> ''")
    asked = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    blocks = max(-(-asked.count() // block), 1)
    id_type, doc_type = asked.schema["id"].dataType.simpleString(), texts.schema["doc"].dataType.simpleString()
    out = None
    for b in range(blocks):
        here = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        terms = [item_terms(r["text"]) for r in here]
        vocabulary: dict[bytes, int] = {}
        for t in terms:
            for term in t:
                vocabulary.setdefault(term, len(vocabulary))
        counted = stored(texts.mapInArrow(_counted(vocabulary), StructType.fromDDL(f"doc {doc_type}, n long, words array<int>, counts array<long>")), "counts")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        # As many rows as the block of items has words.
        df = dict(counted.select(F.explode("words").alias("word")).groupBy("word").count().collect())
        scoring = Scoring(n_docs, n_terms)
        weighed = []
        for t in terms:
            held = [vocabulary[x] for x in t if vocabulary[x] in df]
            weighed.append(Item(held, [scoring.weight(df[w]) for w in held]))
        found = counted.where(F.size("words") > 0).mapInArrow(
            _searched(weighed, scoring, max(len(vocabulary), 1), k), StructType.fromDDL(f"item long, doc {doc_type}, score long")
        )
        best = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(here)], f"item long, item_id {id_type}")
        top = top.join(names, "item").select(F.col("item_id").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
        out = top if out is None else out.unionByName(top)
    return out
