"""Exact top-k inner products by block-at-a-time pruning.

Vectors are laid out by the pivot that they point to most, dealt into ranges of about
``PER_RANGE`` and, within a range, cut into blocks of ``PER_BLOCK`` consecutive ones: a
block is one row with its vectors (the forward index) and the largest and least value of
each component. Since values have signs, the most a block can score for a query is the
sum of its components times the block's largest, or where negative least, value.

A query first searches the range with the greatest such sum. Its k-th score there
is a bound: the query then goes to those other ranges alone whose sum reaches it. In a range
it takes blocks in descending order of their sums and stops when the next sum falls below
its k-th score. Queries meet ranges in cells of bounded size: the queries of a range are
dealt over as many cells as they fill, so no cell grows with the queries of one range.

What the driver and every task see is one sum table: ranges are at most ``MOST_RANGES``, and
grow beyond ``PER_RANGE`` instead. Pivots are a sample of ``PIVOTS`` vectors; they only
lay out blocks, and the result is exact whatever they are.

Defined results: null vectors and vectors with a null or non-finite component, or one
whose product with the scale is not finite, take no part; a shorter vector's missing
components are zero, so empty vectors score 0; scores are exact up to 63 bits and a sign, and
beyond them ties at that limit; each row is a candidate of its own, so repeated rows are separate and a query
leaves out only its own row; null ids are never queries and come last in ties; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark import TaskContext

from reefpulse.llm.store import bounded_batches, stored

PER_BLOCK, PER_RANGE, MOST_RANGES, PIVOTS = 128, 8192, 1024, 64
# Queries in one cell, candidate scores a cell holds before it keeps each query's best alone.
CELL, PENDING = 1024, 1 << 20
NO_ID = np.iinfo(np.int64).max
LOWEST = -NO_ID


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` values, shorter ones filled up with zeros."""
    lengths, values = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = values
    return out


def _list(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.ravel(), pa.float64()))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact: in doubles, in 64 bits or in Python's integers, as their size asks.

    Beyond 64 bits it is the limit.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [np.array([[int(x) for x in row] for row in m], object) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, LOWEST, -LOWEST).astype(np.int64)


def _sums(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that any vector between low and high can score, a row for each query."""
    return _products(np.hstack((np.maximum(queries, 0), np.minimum(queries, 0))), np.hstack((high, low)))


def _pivoted(pivots: np.ndarray):
    """The pivot to which each vector points most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), pivots.shape[1])
            best = (v @ pivots.T).argmax(axis=1) if len(pivots) else np.zeros(len(v), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int64))], [*batch.schema.names, "pivot"])

    return run


def _blocks(width: int):
    """One row for each block of consecutive vectors of a partition, which is a range."""
    def cut(rows: pa.Table, of: int) -> pa.RecordBatch:
        v = _matrix(rows.column("v").combine_chunks(), width)
        one = lambda values: pa.array([values])
        return pa.RecordBatch.from_arrays(
            [pa.array([of], pa.int64()), one(rows.column("uid").to_pylist()), pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())),
             _list(v.reshape(1, -1)), _list(v.max(axis=0, keepdims=True)), _list(v.min(axis=0, keepdims=True))],
            ["range", "uids", "ids", "v", "high", "low"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, n = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PER_BLOCK:
                rows = pa.Table.from_batches(held)
                whole = n - n % PER_BLOCK
                for at in range(0, whole, PER_BLOCK):
                    yield cut(rows.slice(at, PER_BLOCK), of)
                held, n = rows.slice(whole).to_batches(), n - whole
        if n:
            yield cut(pa.Table.from_batches(held), of)

    return run


class _Best:
    """The k best candidates of each of some queries."""

    def __init__(self, k: int, n: int, least: list):
        self.k, self.n = k, n
        # A score below this is none of the k best.
        self.bar = np.array([LOWEST if x is None else x for x in least], np.int64)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.pending = 0

    def put(self, query: np.ndarray, score: np.ndarray, uid: np.ndarray, vec: np.ndarray) -> None:
        self.rows.append((query, score, uid, vec))
        self.pending += len(query)
        if self.pending > PENDING:
            self.shrink()

    def shrink(self) -> None:
        """Keeps each query's k best, ties by id and then row, and raises its bar."""
        if not self.rows:
            return
        query, score, uid, vec = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((uid, vec, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, place = order[place < self.k], query[place < self.k], place[place < self.k]
        last = place == self.k - 1
        self.bar[query[last]] = np.maximum(self.bar[query[last]], score[order][last])
        self.rows, self.pending = [(query, score[order], uid[order], vec[order])], len(order)


def _cell(k: int, width: int):
    """The k best of one range for some queries."""
    names = ["uid", "query_id", "vec_uid", "vec_id", "score"]

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        none = pa.table({n: pa.array([], pa.int64()) for n in names})
        if not len(queries) or not len(blocks):
            return none
        q, own = _matrix(queries.column("v").combine_chunks(), width), queries.column("uid").to_numpy()
        high, low = (_matrix(blocks.column(c).combine_chunks(), width) for c in ("high", "low"))
        uids = [np.array(x, np.int64) for x in blocks.column("uids").to_pylist()]
        ids = [np.array([NO_ID if y is None else y for y in x], np.int64) for x in blocks.column("ids").to_pylist()]
        held = blocks.column("v").combine_chunks()
        vectors = [held[b].values.to_numpy(zero_copy_only=False).reshape(len(uids[b]), width) for b in range(len(blocks))]
        sums = _sums(q, high, low)
        order = np.argsort(-sums, axis=1, kind="stable")
        best = _Best(k, len(q), queries.column("least").to_pylist())
        alive = np.arange(len(q))
        for turn in range(len(blocks)):
            block = order[alive, turn]
            going = sums[alive, block] >= best.bar[alive]
            alive, block = alive[going], block[going]
            if not len(alive):
                break
            for b in np.unique(block).tolist():
                here = alive[block == b]
                score = _products(q[here], vectors[b])
                good = (score >= best.bar[here][:, None]) & (own[here][:, None] != uids[b][None, :])
                at, which = np.nonzero(good)
                best.put(here[at], score[at, which], uids[b][which], ids[b][which])
            best.shrink()
        best.shrink()
        if not best.rows:
            return none
        at, score, uid, vec = best.rows[0]
        return pa.table(
            [pa.array(own[at]), queries.column("id").take(pa.array(at)), pa.array(uid), pa.array(vec, mask=vec == NO_ID), pa.array(score, pa.int64())], names
        )

    return run


def _reached(high: np.ndarray, low: np.ndarray, ranges: np.ndarray, first: bool):
    """For each query the range of the greatest sum, or all others whose sum reaches ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _sums(_matrix(batch.column("v"), high.shape[1]), high, low)
            top = sums.argmax(axis=1)
            if first:
                at, to = np.arange(len(top)), top
            else:
                least = batch.column("least").to_pylist()
                goes = np.array([np.ones(len(ranges), bool) if x is None else s >= x for s, x in zip(sums, least)]).reshape(len(top), len(ranges))
                goes[np.arange(len(top)), top] = False
                at, to = np.nonzero(goes)
            for lo in range(0, len(at), 5000):
                some = batch.take(pa.array(at[lo : lo + 5000]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(ranges[to[lo : lo + 5000]])], [*some.schema.names, "range"])

    return run


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """uid, id and v (floor(scale * component), whole numbers in doubles) of vectors that take part."""
    scaled = F.transform(F.col(embedding), lambda x: F.lit(float(scale)) * x.cast("double"))
    fit = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(vec_id).cast("long").alias("id"), scaled.alias("v")).where(F.col("v").isNotNull() & fit)
    # From 2 ** 53 on doubles are whole; floor gives a long, which larger ones would overflow.
    floored = F.transform("v", lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x))
    return kept.select(F.monotonically_increasing_id().alias("uid"), "id", floored.alias("v"))


def top_products(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, scale: float = 64.0
) -> DataFrame:
    """query_id, rank, vec_id and score: for each row for which ``is_query`` (of column ``id``) holds, its k best other rows.

    Vectors are turned into whole numbers, floor(``scale`` * component); ties go to the smaller id.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    known = stored(whole_vectors(vectors, vec_id, embedding, scale), "vectors")
    n, width = known.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(width or 0, 1)
    sample = known.select("v", F.xxhash64("uid").alias("h")).orderBy("h").limit(PIVOTS).toPandas()["v"].tolist()
    pivots = np.zeros((len(sample), width))
    for row, v in zip(pivots, sample):
        row[: len(v)] = v
    ranges = min(max(-(-n // PER_RANGE), 1), MOST_RANGES)
    near = known.mapInArrow(_pivoted(pivots), "uid long, id long, v array<double>, pivot long")
    laid = near.repartitionByRange(ranges, "pivot", "uid").sortWithinPartitions("pivot", "uid").select("uid", "id", "v")
    blocks = stored(
        laid.mapInArrow(_blocks(width), "range long, uids array<long>, ids array<long>, v array<double>, high array<double>, low array<double>"), "blocks"
    )
    ends = [f(F.col(c)[i]).alias(f"{c}{i}") for f, c in ((F.max, "high"), (F.min, "low")) for i in range(width)]
    edges = blocks.groupBy("range").agg(F.array(*ends[:width]).alias("high"), F.array(*ends[width:]).alias("low")).orderBy("range").collect()
    high, low = (np.array([r[c] for r in edges], float).reshape(len(edges), width) for c in ("high", "low"))
    names = np.array([r["range"] for r in edges], np.int64)
    found = "uid long, query_id long, vec_uid long, vec_id long, score long"

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        """Each query's k best in the ranges it goes to."""
        going = queries.mapInArrow(_reached(high, low, names, first), "uid long, id long, v array<double>, least long, range long")
        going = stored(going, "going")
        cells = going.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
        cells = stored(cells, "cells")
        cell = F.pmod(F.xxhash64("uid"), F.col("cells")).cast("int").alias("cell")
        dealt = going.join(cells, "range").select("range", cell, "uid", "id", "v", "least")
        copies = cells.select(F.col("range").alias("of"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
        spread = blocks.join(copies, F.col("range") == F.col("of")).select("range", "cell", "uids", "ids", "v", "high", "low")
        both = dealt.groupBy("range", "cell").cogroup(spread.groupBy("range", "cell"))
        return both.applyInArrow(_cell(k, width), found)

    if not len(names):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = known.where(is_query).select("uid", "id", "v")
    best = W.partitionBy("uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "vec_uid")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    near = stored(searched(asked.withColumn("least", F.lit(None).cast("long")), True), "near")
    bars = near.groupBy("uid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    far = searched(asked.join(bars.select("uid", "least"), "uid", "left").select("uid", "id", "v", "least"), False)
    return ranked(near.unionByName(far)).select("query_id", "rank", "vec_id", "score")
