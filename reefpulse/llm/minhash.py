"""Near duplicates by b-bit MinHash.

A document is the set of its distinct word shingles. Documents with equal sets are
one class from the start, whatever their number. For each class 200 minima are taken;
bands of five give the candidates, and two bits of each minimum, packed, an estimate
of the similarity: the share of equal pairs of bits, corrected for the quarter that
agree by chance. Candidates whose estimate is more than five standard errors under
the threshold are dropped, all others are confirmed on the full sets.

A bucket is not expanded into pairs. Its members are compared with one of them, and
only buckets that hold several components then need more. Small ones are compared in
full across components. In large ones further rounds compare another member with the
rest; what is then outside the main component of a group is compared with the whole
group on full sets, in blocks of bounded size that yield one link for a member and a
component. So no link between candidates is lost, however large a group. At a similarity of 0.8 a pair escapes all 40 bands with
probability 1e-7.

Defined results: an empty table gives an empty result; null or empty text has an empty set and is linked with nothing;
fewer words than a shingle are one shingle; rows with equal texts are one class, and
of those that share the least id all are kept; ids may be null and then never lead
a component that has another id; other columns are carried along. Rows are dropped by
id and text, never by id alone; of a component without ids one text stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from reefpulse.llm.components import components
from reefpulse.llm.store import bounded_batches, stored
from reefpulse.llm.wordhash import Words, chunks, mixed, span_hashes

MINIMA, ROWS = 200, 5
BANDS = MINIMA // ROWS
_A = mixed(np.arange(1000, 1000 + MINIMA, dtype=np.uint64)) | np.uint64(1)
_B = mixed(np.arange(5000, 5000 + MINIMA, dtype=np.uint64))
# Bits of the packed signature: two a minimum, in words of 32 pairs.
WORDS = -(-MINIMA // 32)
# Packed elements of a full set: the low 48 bits of each 64-bit hash.
BYTES = 6
BLOOM_WORDS = 1 << 17
# Members of buckets up to this size are compared at once where components differ.
SMALL_BUCKET = 32
# Full sets in a block of a large group; two blocks meet in a task.
BLOCK_BYTES = 1 << 22


def _sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes ordered by text, and where each text's begin."""
    at = words.gram_starts(k)
    h, t = span_hashes(words.hashes, at, at + k), words.text_of(at)
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(few):
        whole = span_hashes(words.hashes, words.offsets[few], words.offsets[few + 1])
        h, t = np.concatenate((h, whole)), np.concatenate((t, few))
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[new], t[new]
    return h, np.searchsorted(t, np.arange(len(words.counts) + 1))


def _set_ids(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, from its size and two independent sums of its elements."""
    one, two = mixed(h), mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    a, b = np.add.reduceat(one, starts), np.bitwise_xor.reduceat(two, starts)
    return mixed(mixed(a ^ mixed((ends - starts).astype(np.uint64))) + b)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for lo, hi in chunks(text := batch.column("text")):
                h, offsets = _sets(Words(text.slice(lo, hi - lo), lower=True), k)
                n = np.diff(offsets)
                full = np.flatnonzero(n > 0)
                starts = offsets[full]
                sid, bits, bands = np.zeros(hi - lo, np.int64), np.zeros((hi - lo, WORDS), np.int64), np.zeros((hi - lo, BANDS), np.int64)
                if len(full):
                    sid[full] = _set_ids(h, starts, starts + n[full]).view(np.int64)
                    pack, keys = np.zeros((len(full), WORDS), np.uint64), np.zeros((len(full), BANDS), np.uint64)
                    for i in range(MINIMA):
                        least = np.minimum.reduceat((h * _A[i] + _B[i]) >> np.uint64(24), starts)
                        pack[:, i // 32] |= (least & np.uint64(3)) << np.uint64(2 * (i % 32))
                        band = keys[:, i // ROWS]
                        keys[:, i // ROWS] = mixed(band ^ mixed(least + np.uint64(i)))
                    bits[full], bands[full] = pack.view(np.int64), keys.view(np.int64)
                empty = pa.array(n == 0)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n),
                     pa.array(np.ma.masked_array(sid, n == 0)) if len(sid) else pa.array(sid),
                     _lists(bits), _lists(bands), empty],
                    ["id", "n", "sid", "bits", "bands", "empty"],
                )

    return run


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))


def _full_sets(k: int, bloom: np.ndarray):
    """Packed sets of the texts whose set id passes the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(text := batch.column("text")):
                h, offsets = _sets(Words(text.slice(lo, hi - lo), lower=True), k)
                full = np.flatnonzero(np.diff(offsets) > 0)
                if not len(full):
                    continue
                starts, ends = offsets[full], offsets[full + 1]
                sid = _set_ids(h, starts, ends)
                word, bit = sid % np.uint64(BLOOM_WORDS), (sid >> np.uint64(58)).astype(np.uint64)
                keep = np.flatnonzero((bloom[word.astype(np.int64)] >> bit) & np.uint64(1))
                packed = h.view(np.uint8).reshape(-1, 8)[:, :BYTES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid[keep].view(np.int64)),
                     pa.array([packed[s:e].tobytes() for s, e in zip(starts[keep].tolist(), ends[keep].tolist())], pa.binary())],
                    ["sid", "items"],
                )

    return run


def _unpacked(items: bytes) -> np.ndarray:
    wide = np.zeros((len(items) // BYTES, 8), np.uint8)
    wide[:, :BYTES] = np.frombuffer(items, np.uint8).reshape(-1, BYTES)
    return wide.view(np.uint64).ravel()


def _confirm(percent: int):
    """Keeps pairs with 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = _unpacked(a.as_py()), _unpacked(b.as_py())
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _estimate(a: Column, b: Column) -> Column:
    """Similarity from packed pairs of bits, corrected for chance agreement."""
    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    differ = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    return (1 - differ / F.lit(MINIMA) - 0.25) / 0.75


def _compare_blocks(percent: int):
    """Links between members of two blocks with different roots, one for each member and other root at most."""
    def run(block: pa.Table) -> pa.Table:
        sid, root, side = (block.column(c).to_numpy() for c in ("sid", "root", "side"))
        sets = [_unpacked(x.as_py()) for x in block.column("items")]
        right = np.flatnonzero(side)
        size = np.array([len(x) for x in sets])
        # For each element of the right side, which sets there hold it.
        items = np.concatenate([sets[k] for k in right] or [np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(right)), size[right])
        order = np.argsort(items, kind="stable")
        items, owner = items[order], owner[order]
        u, v = [], []
        for k in np.flatnonzero(side == 0):
            lo, hi = np.searchsorted(items, sets[k]), np.searchsorted(items, sets[k], side="right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            both = np.bincount(owner[at], minlength=len(right))
            linked = np.flatnonzero((100 * both >= percent * (size[k] + size[right] - both)) & (root[right] != root[k]))
            _, first = np.unique(root[right][linked], return_index=True)
            u += [sid[k]] * len(first)
            v += sid[right][linked[first]].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


class _Search:
    """Links among classes (sid) of one table."""

    def __init__(self, docs: DataFrame, signed: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent = docs, k, percent
        share = 0.25 + 0.75 * percent / 100
        self.least = percent / 100 - 5 * (share * (1 - share) / MINIMA) ** 0.5 / 0.75
        self.classes = signed.where("not empty").select("sid", "bits", "bands").dropDuplicates(["sid"])
        banded = self.classes.select("sid", F.explode("bands").alias("key"))
        shared = banded.groupBy("key").agg(F.min("sid").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
        self.buckets = stored(banded.join(shared, "key").select("key", "sid", "lead"), "buckets")
        self.sets = stored(self._sets(), "sets")

    def _sets(self) -> DataFrame:
        """Full sets of the classes in shared buckets, once each.

        A filter of fixed size picks the texts; what it lets through wrongly falls
        out in the join.
        """
        needed = self.buckets.select("sid").distinct()
        place = F.pmod(F.col("sid"), F.lit(BLOOM_WORDS))
        mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("sid", 58).cast("int"))
        filled = needed.groupBy(place.alias("w")).agg(F.bit_or(mark).alias("bits")).toPandas()
        bloom = np.zeros(BLOOM_WORDS, np.uint64)
        bloom[filled["w"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
        found = self.docs.select("text").mapInArrow(_full_sets(self.k, bloom), "sid long, items binary")
        return found.join(needed, "sid", "left_semi").dropDuplicates(["sid"])

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that are links."""
        bits = self.classes.select("sid", "bits")
        likely = (
            pairs.join(bits.withColumnsRenamed({"sid": "u", "bits": "a"}), "u")
            .join(bits.withColumnsRenamed({"sid": "v", "bits": "b"}), "v")
            .where(_estimate(F.col("a"), F.col("b")) >= self.least).select("u", "v")
        )
        return self._exact(stored(likely, "likely"))

    def _exact(self, likely: DataFrame) -> DataFrame:
        full = likely.join(self.sets.withColumnsRenamed({"sid": "u", "items": "a"}), "u")
        full = full.join(self.sets.withColumnsRenamed({"sid": "v", "items": "b"}), "v")
        return full.select("u", "v", "a", "b").mapInArrow(_confirm(self.percent), "u long, v long")

    def roots(self, rounds: int) -> DataFrame:
        """node and root of all classes that have a link.

        A bucket whose members have one root is settled for good, so each round reads
        the members of those buckets alone that the round before left with several.
        """
        members = self.buckets.select("key", "sid")
        star = self.buckets.where("sid <> lead").select(F.col("lead").alias("u"), F.col("sid").alias("v")).distinct()
        roots = stored(components(stored(self.confirmed(star), "links")), "roots")
        for turn in range(1, rounds + 2):
            named = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left")
            named = stored(named.select("key", "sid", F.coalesce("root", "sid").alias("root")), "named")
            several = named.groupBy("key").agg(
                F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"),
                F.min_by(F.struct("sid", "root"), F.xxhash64("sid", F.lit(turn))).alias("lead"),
            ).where("lo < hi").select("key", "n", "lead")
            apart = stored(named.join(several, "key"), "apart")
            members = apart.select("key", "sid")
            large = apart.where(F.col("n") > SMALL_BUCKET)
            hot = not large.isEmpty()
            if turn <= rounds and hot:
                pairs = large.where("root <> lead.root").select(F.least("sid", "lead.sid").alias("u"), F.greatest("sid", "lead.sid").alias("v"))
                more = stored(self.confirmed(pairs.distinct()), "links")
                if not more.isEmpty():
                    roots = self._merged(roots, more)
                    continue
            more = self._exact(stored(self._across(apart.where(F.col("n") <= SMALL_BUCKET)), "likely"))
            more = stored(more.unionByName(self._in_blocks(large)) if hot else more, "links")
            return roots if more.isEmpty() else self._merged(roots, more)

    def _across(self, members: DataFrame) -> DataFrame:
        """Likely pairs (u < v) of one small bucket and different components."""
        mine = members.select("key", "sid", "root").join(self.classes.select("sid", "bits"), "sid")
        other = mine.select("key", F.col("sid").alias("s"), F.col("root").alias("r"), F.col("bits").alias("b"))
        near = (F.col("root") < F.col("r")) & (_estimate(F.col("bits"), F.col("b")) >= self.least)
        pairs = mine.join(other.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & near)
        return pairs.select(F.least("sid", "s").alias("u"), F.greatest("sid", "s").alias("v")).distinct()

    def _in_blocks(self, large: DataFrame) -> DataFrame:
        """Links across components of large buckets, by full sets in blocks of bounded size.

        Components that share a large bucket, directly or by others, form a group. In
        each group all that is not of its largest component is compared with everything.
        """
        tied = components(stored(large.select(F.col("root").alias("u"), F.col("lead.root").alias("v")).distinct(), "tied"))
        tied = tied.select(F.col("node").alias("root"), F.col("root").alias("g"))
        members = large.select("sid", "root").distinct().join(tied, "root").join(self.sets, "sid")
        members = stored(members.withColumn("bytes", F.octet_length("items").cast("long")), "group")
        per = members.groupBy("g", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
        per = per.groupBy("g").agg(
            F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("bytes").alias("all"), F.max_by("bytes", F.struct("n", "root")).alias("of_main")
        )
        blocks = F.ceil(F.col("of_main") / BLOCK_BYTES).cast("int"), F.ceil((F.col("all") - F.col("of_main")) / BLOCK_BYTES).cast("int")
        dealt = members.join(per.select("g", "main", blocks[0].alias("a"), blocks[1].alias("b")), "g")
        # Right side: everything, in one block each; left side: what is not of the main component.
        rest = F.col("root") != F.col("main")
        own = F.when(rest, F.col("a") + F.pmod(F.xxhash64("sid"), F.col("b")).cast("int")).otherwise(F.pmod(F.xxhash64("sid"), F.col("a")).cast("int"))
        dealt = dealt.withColumn("own", own)
        right = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select("g", "i", F.col("own").alias("j"), F.lit(1).alias("side"), "sid", "root", "items")
        left = dealt.where(rest).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("a") + F.col("b") - 1))).select(
            "g", (F.col("own") - F.col("a")).alias("i"), "j", F.lit(0).alias("side"), "sid", "root", "items"
        )
        both = right.unionByName(left).groupBy("g", "i", "j")
        return both.applyInArrow(_compare_blocks(self.percent), "u long, v long")

    def _merged(self, roots: DataFrame, more: DataFrame) -> DataFrame:
        """Roots after further links, found among the roots alone."""
        ends = more
        for end in ("u", "v"):
            named = roots.select(F.col("node").alias(end), F.col("root").alias("__root"))
            ends = ends.join(named, end, "left").withColumn(end, F.coalesce("__root", end)).drop("__root")
        above = components(stored(ends, "ends")).select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = more.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(roots, "node", "left_anti")
        every = roots.unionByName(new.select("node", F.col("node").alias("root")))
        return stored(every.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")


def _members(known: DataFrame, shingle: int, percent: int, rounds: int) -> DataFrame:
    """id, n, empty and root of each row of ``known`` (id of any type, text)."""
    bounded_batches(known.sparkSession)
    out = StructType([known.schema["id"], *StructType.fromDDL("n long, sid long, bits array<long>, bands array<long>, empty boolean")])
    signed = stored(known.mapInArrow(_signatures(shingle), out), "signatures")
    roots = _Search(known, signed, shingle, percent).roots(rounds)
    named = signed.select("id", "n", "sid", "empty").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    return stored(named.select("id", "n", "empty", F.coalesce("root", "sid").alias("root")), "members")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, rounds: int = 2
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked with 100 * intersection >= ``percent`` * union of their sets
    of ``shingle``-word shingles; component_id is the least id reachable.
    """
    known = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    named = _members(known, shingle, percent, rounds)
    leads = named.where("not empty").groupBy("root").agg(F.min("id").alias("lead"))
    linked = named.where("not empty").join(leads, "root").select("id", "n", "lead")
    alone = named.where("empty").select("id", "n", F.col("id").alias("lead"))
    return linked.unionByName(alone).select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("lead").alias("component_id"),
        F.col("id").eqNullSafe(F.col("lead")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, rounds: int = 2
) -> DataFrame:
    """The rows of ``docs`` that lead their component, or have no words, with all their columns.

    A row's verdict is that of its id and text (by two hashes); without any id in a
    component the text that hashes lowest leads.
    """
    number, t = F.col(doc_id).cast("long"), F.col(text)
    one, two = F.xxhash64(t), F.xxhash64(F.lit(1), t)
    row = F.struct(number.isNull().alias("none"), number.alias("id"), one.alias("one"), two.alias("two"))
    named = _members(docs.select(row.alias("id"), t.alias("text")), shingle, percent, rounds).where("not empty")
    leads = named.groupBy("root").agg(F.min("id").alias("lead"))
    led = F.when(F.col("lead.none"), (F.col("id.one") == F.col("lead.one")) & (F.col("id.two") == F.col("lead.two"))).otherwise(
        F.col("id.id").eqNullSafe(F.col("lead.id"))
    )
    gone = named.join(leads, "root").where(~led).select(
        F.col("id.id").alias("__gone"), F.col("id.one").alias("__one"), F.col("id.two").alias("__two")
    ).distinct()
    same = docs[doc_id].cast("long").eqNullSafe(gone["__gone"])
    same = same & (F.xxhash64(docs[text]) == gone["__one"]) & (F.xxhash64(F.lit(1), docs[text]) == gone["__two"])
    return docs.join(gone, same, "left_anti")
