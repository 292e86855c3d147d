"""Phrase collocations, counted in HAT-tries.

Phrases of one length are counted in one pass over the text. Each task keeps, per
language, a burst trie over word ids: under a few levels of slots, one level a word,
lie hash containers; one that grows over ``BURST`` keys is burst into slots by the next
word. When a task holds more than ``LIMIT`` keys it spills whole subtrees, the largest
first, as sorted runs. Runs meet in partitions by prefix (all words but the last, and a
slot of the last one, so that a prefix with much of the data is many partitions), where
Spark sorts or hashes them together and adds up.

A phrase that occurs ``least`` times holds only phrases that do. So the pass over n
words counts only where both phrases of n - 1 words do, by a filter of bounded size
over their hashes: it never misses one, and what it lets through wrongly is only counted
in vain. The counts themselves are by the words, not by hashes.

Defined results: A-Z are lower-cased; null and empty texts have no words; a null
language is ``und``; repeated rows count each; the id plays no part; an empty table gives
an empty result; texts of any length are read in windows that overlap by a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from reefpulse.llm.store import bounded_batches, stored
from reefpulse.llm.wordhash import chunks, mixed

# Slots of a trie node, keys of a container before it bursts, keys a task holds before it spills.
SLOTS, BURST, LIMIT = 64, 4096, 1 << 20
# Words a task numbers before it spills all and starts anew; bytes of text in hand.
VOCABULARY, WINDOW = 1 << 20, 1 << 20
# Bits of a filter for each phrase, and in all at most.
BITS_EACH, MOST_BITS = 16, 1 << 28
# Partitions of one prefix.
PREFIX_SLOTS = 64

BREAK = b"\xff"
_FOLD = bytes.maketrans(b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b" abcdefghijklmnopqrstuvwxyz" + BREAK * 10)


class HatTrie:
    """Counts of keys of ``n`` word ids, ``bits`` each, the first word highest."""

    def __init__(self, n: int, bits: int):
        self.shifts = [bits * (n - 1 - i) for i in range(n)]
        self.root: list = [None] * SLOTS
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._add(self.root, 0, keys, counts)

    def _add(self, node: list, depth: int, keys: np.ndarray, counts: np.ndarray) -> None:
        slot = (keys >> self.shifts[depth]) % SLOTS
        order = np.argsort(slot, kind="stable")
        keys, counts, edges = keys[order], counts[order], np.searchsorted(slot[order], np.arange(SLOTS + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            some, their = keys[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]]
            child = node[s]
            if isinstance(child, list):
                self._add(child, depth + 1, some, their)
                continue
            if child is None:
                child = node[s] = {}
            had, get = len(child), child.get
            for k, c in zip(some.tolist(), their.tolist()):
                child[k] = get(k, 0) + c
            self.size += len(child) - had
            if len(child) > BURST and depth + 1 < len(self.shifts):
                node[s] = [None] * SLOTS
                self.size -= len(child)
                self._add(node[s], depth + 1, *_table(child))

    def spill(self, left: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts of whole subtrees, taken out until at most ``left`` keys stay."""
        sizes = [_size(x) for x in self.root]
        for s in sorted(range(SLOTS), key=lambda s: -sizes[s]):
            if self.size <= left or not sizes[s]:
                return
            tables = [_table(x) for x in _containers(self.root[s])]
            self.root[s], self.size = None, self.size - sizes[s]
            yield np.concatenate([k for k, _ in tables]), np.concatenate([c for _, c in tables])


def _containers(child: list | dict | None) -> Iterator[dict]:
    if isinstance(child, list):
        for x in child:
            yield from _containers(x)
    elif child:
        yield child


def _size(child: list | dict | None) -> int:
    return sum(map(len, _containers(child)))


def _table(container: dict) -> tuple[np.ndarray, np.ndarray]:
    n = len(container)
    return np.fromiter(container.keys(), np.int64, n), np.fromiter(container.values(), np.int64, n)


def _chained(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase one word longer."""
    return mixed(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


class Filter:
    """Bits of hashes: all that were put in are found, and some others."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h % np.uint64(len(self.words))).astype(np.int64)
        return (self.words[at] >> (h >> np.uint64(58))) & np.uint64(1) == 1

    @staticmethod
    def of(phrases: DataFrame, n: int) -> "Filter":
        """From lang and phrase (of n words); bits by their number, bounded."""
        size = min(max(phrases.count() * BITS_EACH, 1 << 12), MOST_BITS) // 64

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = np.array([_seed(x) for x in batch.column("lang").to_pylist()], np.uint64)
                words = [p.split(b" ") for p in batch.column("phrase").cast(pa.binary()).to_pylist()]
                for i in range(n):
                    h = _chained(h, np.array([xxhash.xxh3_64_intdigest(w[i]) for w in words], np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((h % np.uint64(size)).astype(np.int64)), pa.array((np.uint64(1) << (h >> np.uint64(58))).view(np.int64))], ["at", "bit"]
                )

        filled = phrases.select("lang", "phrase").mapInArrow(hashed, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
        words = np.zeros(size, np.uint64)
        words[filled["at"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
        return Filter(words)


class _Numbers(dict):
    """Consecutive numbers of words, in order of their first occurrence; 0 is the break."""

    def __init__(self):
        super().__init__({BREAK: 0})
        self.words = [BREAK]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


class _Counter:
    """Phrases of n words of one language in one task."""

    def __init__(self, lang: str, n: int, known: dict[int, Filter]):
        self.lang, self.n, self.known, self.seed = lang, n, known, _seed(lang)
        self.bits = 62 // n
        self._restart()

    def _restart(self) -> None:
        self.trie, self.numbers = HatTrie(self.n, self.bits), _Numbers()
        # For each word number its id in the trie (0 where no phrase counts across it), and its hash; for each id the word.
        self.ids, self.hashes, self.words = np.zeros(1, np.int64), np.zeros(1, np.uint64), [b""]

    def read(self, data: bytes) -> Iterator[pa.RecordBatch]:
        data = data.translate(_FOLD).replace(BREAK, b" " + BREAK + b" ")
        at, carried = 0, np.zeros(0, np.int64)
        while at < len(data):
            end = data.find(b" ", at + WINDOW)
            end = len(data) if end < 0 else end
            words = data[at:end].split()
            numbers = np.concatenate((carried, np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))))
            self._learn()
            self._count(numbers)
            tail = numbers[max(0, len(numbers) - self.n + 1) :] if self.n > 1 else numbers[:0]
            at, carried = end, tail
            if self.trie.size > LIMIT:
                yield from self.runs(LIMIT // 2)
            if len(self.numbers) > VOCABULARY or len(self.words) >= 1 << self.bits - 1:
                yield from self.runs(0)
                last = [self.numbers.words[k] for k in tail.tolist()]
                self._restart()
                carried = np.fromiter(map(self.numbers.__getitem__, last), np.int64, len(last))
                self._learn()

    def _learn(self) -> None:
        """Hashes and ids of words that are new."""
        fresh = self.numbers.words[len(self.ids) :]
        if not fresh:
            return
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))
        keep = self.known[1].has(_chained(np.full(len(h), self.seed), h)) if 1 in self.known else np.ones(len(h), bool)
        ids = np.where(keep, len(self.words) - 1 + np.cumsum(keep), 0)
        self.words += [w for w, k in zip(fresh, keep.tolist()) if k]
        self.ids, self.hashes = np.concatenate((self.ids, ids)), np.concatenate((self.hashes, h))

    def _count(self, numbers: np.ndarray) -> None:
        n, m = self.n, len(numbers) - self.n + 1
        if m <= 0:
            return
        ids = self.ids[numbers]
        keys, whole = np.zeros(m, np.int64), np.ones(m, bool)
        for i in range(n):
            part = ids[i : i + m]
            keys = (keys << self.bits) | part
            whole &= part > 0
        if n - 1 in self.known and n > 2:
            word = self.hashes[numbers]
            h = np.full(m + 1, self.seed)
            for i in range(n - 1):
                h = _chained(h, word[i : i + m + 1])
            found = self.known[n - 1].has(h)
            whole &= found[:-1] & found[1:]
        keys = keys[whole]
        if len(keys):
            self.trie.add(*np.unique(keys, return_counts=True))

    def runs(self, left: int) -> Iterator[pa.RecordBatch]:
        """What the trie spills, each subtree as a run sorted by its words."""
        words, mask = np.array(self.words, object), (1 << self.bits) - 1
        order = np.argsort(words)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        known = pa.array(self.words, pa.binary()).cast(pa.string())
        for keys, counts in self.trie.spill(left):
            ids = [(keys >> s) & mask for s in self.trie.shifts]
            by = np.zeros(len(keys), np.int64)
            for part in ids:
                by = (by << self.bits) | rank[part]
            by = np.argsort(by)
            for at in range(0, len(by), 10_000):
                some = by[at : at + 10_000]
                phrase = pc.binary_join_element_wise(*[known.take(pa.array(part[some])) for part in ids], " ")
                lang = pa.array([self.lang] * len(some), pa.string())
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(counts[some])], ["lang", "phrase", "n"])


def _runs(n: int, known: dict[int, Filter]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, _Counter] = {}
        for batch in batches:
            text = batch.column("text")
            for lo, hi in chunks(text, WINDOW):
                data = text.slice(lo, hi - lo).cast(pa.binary()).to_pylist()
                langs = batch.column("lang").slice(lo, hi - lo).to_pylist()
                for lang in sorted(set(langs)):
                    counter = counters.setdefault(lang, _Counter(lang, n, known)) if lang not in counters else counters[lang]
                    yield from counter.read(BREAK.join(t for t, x in zip(data, langs) if x == lang))
                while sum(c.trie.size for c in counters.values()) > LIMIT or sum(len(c.numbers) for c in counters.values()) > 2 * VOCABULARY:
                    yield from counters.pop(max(counters, key=lambda x: counters[x].trie.size + len(counters[x].numbers))).runs(0)
        for counter in counters.values():
            yield from counter.runs(0)

    return run


def phrase_counts(texts: DataFrame, n: int, known: dict[int, Filter] | None = None) -> DataFrame:
    """lang, phrase and f of phrases of ``n`` words in ``texts`` (lang, text without nulls).

    ``known`` has filters for shorter phrases; phrases that hold others are left out.
    """
    runs = texts.mapInArrow(_runs(n, known or {}), "lang string, phrase string, n long")
    prefix = F.xxhash64("lang", F.substring_index("phrase", " ", max(n - 1, 1)), F.pmod(F.xxhash64("phrase"), F.lit(PREFIX_SLOTS)))
    merged = runs.withColumn("prefix", prefix).repartition("prefix")
    return merged.groupBy("prefix", "lang", "phrase").agg(F.sum("n").alias("f")).drop("prefix")


def _span(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", words: int = 3, least: int = 10, percent: int = 50, most: int = 2000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``most`` best phrases of 2 to ``words`` words.

    A phrase that occurs a times (``least`` or more) and is cut in two parts that occur l
    and r times scores floor(1000000 * a * a / (l * r)) at its worst cut. It goes if a
    longer one that holds it has at least ``percent`` of its occurrences.
    """
    if not 2 <= words <= 6:
        raise ValueError("words must be from 2 to 6")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text is not null and text <> ''")
    single = stored(phrase_counts(texts, 1), "words")
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    levels, known = [single.where(F.col("f") >= least)], {}
    for n in range(2, words + 1):
        known[n - 1] = Filter.of(levels[-1], n - 1)
        levels.append(stored(phrase_counts(texts, n, known).where(F.col("f") >= least), "phrases"))
    frequent = levels[0]
    for level in levels[1:]:
        frequent = frequent.unionByName(level)
    candidates = levels[1]
    for level in levels[2:]:
        candidates = candidates.unionByName(level)
    candidates = candidates.withColumnRenamed("f", "a")
    parts = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _span(F.col("parts"), F.lit(1), F.col("k")).alias("left"),
        _span(F.col("parts"), F.col("k") + 1, F.size("parts") - F.col("k")).alias("right"),
    )
    for part, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(frequent.withColumnsRenamed({"phrase": part, "f": f}), ["lang", part])
    # Counts have up to 15 digits, so no product passes 38.
    exact = [F.col(c).cast("decimal(15,0)").alias(f"__{c}") for c in ("a", "l", "r")]
    cuts = cuts.select("*", *exact).withColumn("score", F.expr("(__a * __a * 1000000BD) div (__l * __r)"))
    worst = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.col("words")
    longer = candidates.select("lang", "a", parts.alias("words")).where(F.size("words") > 2)
    longer = longer.select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("length"))
    longer = longer.select("lang", "a", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("start"))
    held = longer.select("lang", F.col("a").alias("of"), _span(inner, F.col("start"), F.col("length")).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    kept = worst.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("of") < percent * F.col("a"), F.lit(True)))
    best = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return top.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
