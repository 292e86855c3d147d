"""The numbered queries: each applies one operator of this package to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reefpulse.llm import oracles
from reefpulse.llm.block_topk import top_products
from reefpulse.llm.collocations import collocations
from reefpulse.llm.decontaminate import contaminated
from reefpulse.llm.html_extract import extract_text
from reefpulse.llm.language_id import identify
from reefpulse.llm.license_scan import scan_licenses
from reefpulse.llm.mask_search import ranked_search
from reefpulse.llm.minhash import near_duplicates
from reefpulse.llm.mixing import coin, with_copies, word_count
from reefpulse.llm.quality import CUTOFF, fit, judged, measured, statistics
from reefpulse.llm.store import new_folder, stored
from reefpulse.llm.substring_dedup import drop_repeats
from reefpulse.llm.url_filter import judge_urls
from reefpulse.llm.warc import read_archives, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "op4_near_duplicates": oracles.OP4,
    "op8_warc_salvage": oracles.OP8,
    "op9_source_mix": oracles.OP9,
    "op11_presence_masks": oracles.OP11,
    "op12_block_topk": oracles.OP12,
    "op13_phrase_collocations": oracles.OP13,
}
MIX_SEED = 20


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs, length=20, layout=False).select(
        "doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("dedup.text", 256).alias("kept_sha256")
    )


URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
REJECT_WORDS = ("casino", "pills", "bets", "spam", "ads", "porn", "viagra", "poker")


@query
def op2_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, "url", URL_RULES, REJECT_WORDS)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stored(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), coin(F.col("doc_id"), F.col("text"), MIX_SEED).alias("coin")
        ),
        "sizes",
    )
    mixed = with_copies(sized, weights=(5, 2, 1), total=1.5, cap=2.0)
    return mixed.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


@query
def op10_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = stored(measured(docs).select("doc_id", "quality", "__lang", "__source"), "quality")
    verdicts = judged(known, fit(statistics(known)), CUTOFF)
    return verdicts.select(
        "doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept", F.round("distance", 3).alias("distance"),
    )


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@query
def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


@query
def op5_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )


@query
def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    # The archives are this query's own: a gap in them is an error, not a shorter result.
    whole = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(": ", "path", "problem")).cast("boolean"))
    records = read_archives(spark, path, with_payload=False).where(whole)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


@query
def op12_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), words=3, least=10, percent=50, most=2000)
