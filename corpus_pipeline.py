"""From raw documents to a training mix: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the
columns of ``documents``; the last returns the mix, in which a document may occur twice.

1. quality rules: documents that fail a base rule or are robust outliers go;
2. near duplicates: of each component of similar documents the least id stays;
3. substring dedup: passages of 50 words or more that stand earlier already are cut out,
   and n_chars is counted anew; documents of which nothing is left stay, empty;
4. decontamination: documents that hold a benchmark passage go;
5. mixing: each source is taken as often as its target share of the words asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reefpulse.llm.decontaminate import drop_contaminated
from reefpulse.llm.minhash import drop_near_duplicates
from reefpulse.llm.mixing import mix
from reefpulse.llm.quality import keep_good
from reefpulse.llm.store import stored
from reefpulse.llm.substring_dedup import drop_repeats

REPEAT_WORDS = 50
MIX_SEED = 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, shingle=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = drop_repeats(docs, length=REPEAT_WORDS, layout=True)
    changed = {"text": F.col("dedup.text"), "n_chars": F.when(F.col("dedup.n_removed") > 0, F.length("dedup.text")).otherwise(F.col("n_chars"))}
    return cut.withColumns(changed).select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, seed=MIX_SEED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

# Minimum covariance determinants and MinHash have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
