"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source; a source's weight gives its share of the mix, capped
at a multiple of what it has, the excess going to the others by weight. With rate =
target / size of the source, a document is taken floor(rate) times, and once more
if its own coin, a hash of the seed and its id, falls under the fraction.

Only one row per source is ever ordered; documents meet their source's row in an
equi-join, broadcast by the planner where that table is small and split by AQE
where one source holds much of the rows.

Defined results: null or empty text has size 0 and takes no words; a null source is
a source of its own, last in order; without an id a document's coin comes from its
text; rows with equal ids share a coin; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reefpulse.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    docs: DataFrame, source: str, size: str, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """One row per source: __source, source_size and target, in the unit of ``size``.

    Sources by code point (null last) weigh ``weights`` in turn and share ``total``
    times all sizes; no target is above ``cap`` times its source. With sources
    ordered by how soon they fill up, those before some place are full and the rest
    share what is left at one level, which is the largest level any of them sees.
    """
    per = docs.groupBy(F.col(source).cast("string").alias("__source")).agg(F.sum(size).alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("__source").asc_nulls_last()))
    n = len(weights)
    per = per.withColumn("place", place).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("place") - 1, F.lit(n)) + 1)
    )
    per = per.withColumn("top", F.lit(cap) * F.col("source_size")).withColumn("fill", F.col("top") / F.col("w"))
    every = W.orderBy("fill", "place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("fill", "place").rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(total) * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left)
    common = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(every)
    target = F.least(F.col("top"), F.coalesce(common * F.col("w"), F.col("top")))
    return per.select("__source", "source_size", target.alias("target"))


def coin(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the document alone."""
    key = F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(16.0**13)


def with_copies(
    docs: DataFrame, source: str = "source", size: str = "size", coin_column: str = "coin",
    weights: Sequence[float] = (5, 2, 1), total: float = 1.5, cap: float = 2.0,
) -> DataFrame:
    """``docs`` with source_size, target and copies: how often the mix takes each document."""
    targets = stored(source_targets(docs, source, size, weights, total, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (F.col(coin_column) < rate - F.floor(rate)).cast("long")
    joined = docs.join(targets, docs[source].cast("string").eqNullSafe(targets["__source"]))
    return joined.withColumn("copies", F.floor(rate).cast("long") + extra).drop("__source")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0,
    weights: Sequence[float] = (5, 2, 1), total: float = 1.5, cap: float = 2.0,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    names = docs.columns
    sized = docs.withColumns(
        {"__size": word_count(F.col(text)), "__coin": coin(F.col(doc_id), F.col(text), seed), "__src": F.col(source)}
    )
    sizes = sized.select("__src", "__size")
    targets = stored(source_targets(sizes, "__src", "__size", weights, total, cap), "targets").select(
        F.col("__source"), F.col("source_size").alias("__have"), F.col("target").alias("__want")
    )
    rate = F.when(F.col("__have") > 0, F.col("__want") / F.col("__have")).otherwise(0.0)
    copies = F.floor(rate).cast("int") + (F.col("__coin") < rate - F.floor(rate)).cast("int")
    joined = sized.join(targets, sized["__src"].cast("string").eqNullSafe(targets["__source"]))
    taken = joined.withColumn("__copies", copies).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[f"`{c}`" for c in names])
