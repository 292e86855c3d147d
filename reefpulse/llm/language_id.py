"""Language identification by nearest centroid.

A text is a vector of hashed three-byte grams of its lower-cased UTF-8 letters, with
logarithmic counts, inverse document frequencies and unit length. Each language has
several centroids, from spherical k-means over its sample; a text takes the language
of the centroid with the greatest cosine. A centroid has a radius: the cosine that
nearly all of its own sample reach, less a margin; a text below it is rejected.

Training takes at most ``sample`` texts of a language, those with the least hash of
id and text, and is done by one task per language; document frequencies are summed over
all texts that may be learned from. The model is of fixed size per language (``clusters`` vectors of
2 ** 12 floats). Prediction is one map over all whole texts without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and
not rejected; so is every text if nothing could be learned; a text too short for a
gram has score 0 and the first learned language; rows with a null id are never held
out, and sampled by their texts; repeated rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf

from reefpulse.llm.store import bounded_batches, stored
from reefpulse.llm.wordhash import chunks

DIMS = 1 << 12
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(texts: pa.Array) -> np.ndarray:
    """Counts of hashed three-byte grams, one row per text; what is no letter is one space."""
    low = pc.utf8_lower(texts.fill_null("")).cast(pa.large_string())
    _, ends, data = low.buffers()
    at = np.frombuffer(ends, np.int64)[low.offset : low.offset + len(low) + 1]
    if data is None or at[-1] - at[0] < 3:
        return np.zeros((len(texts), DIMS), np.float32)
    b = _LETTER[np.frombuffer(data, np.uint8)[at[0] : at[-1]]].astype(np.uint32)
    at = at - at[0]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(20)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    whole = row[:-2] == row[2:]
    whole &= ~((b[:-2] == 32) & (b[1:-1] == 32))
    cell = row[:-2][whole] * DIMS + code[whole]
    return np.bincount(cell, minlength=len(texts) * DIMS).reshape(-1, DIMS).astype(np.float32)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(grams(texts)) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def has_letter(texts: pa.Array) -> pa.Array:
    return pc.match_substring_regex(texts, r"\p{L}").fill_null(False)


def cluster(x: np.ndarray, k: int, turns: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts; centroids, and each row's cosine with its own."""
    picked = [0]
    while len(picked) < min(k, len(x)):
        picked.append(int((x @ x[picked].T).max(axis=1).argmin()))
    c = x[picked]
    for _ in range(turns):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c, x @ c.T


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, rows = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for lo, hi in chunks(texts := batch.column("text")):
            n += (grams(texts.slice(lo, hi - lo)) > 0).sum(axis=0)
        rows += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(n, rows))], ["dim", "n"])


def learn(rows: DataFrame, clusters: int = 3, sample: int = 500, margin: float = 0.1) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, centroids and radii (one per centroid), and inverse document frequencies.

    ``rows`` has text, lang and id; texts without letters are not learned from.
    """
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.xxhash64("id", "text")
    counts = stored(usable.groupBy("lang").count(), "counts")
    # A first cut by hash keeps about four samples a language, so that little is ordered.
    share = (order.cast("double") / 2.0**64 + 0.5) * F.col("count") <= 4 * sample
    some = usable.join(counts, "lang").where(share).drop("count")
    place = F.row_number().over(W.partitionBy("lang").orderBy(order, "id", F.xxhash64(F.lit(1), "text")))
    chosen = stored(some.withColumn("place", place).where(F.col("place") <= sample).select("lang", "text"), "sample")
    df = usable.select("text").mapInArrow(_document_frequency, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(DIMS + 1)
    n[df["dim"].to_numpy(np.int64)] = df["n"].to_numpy(np.float64)
    idf = np.log((1 + n[-1]) / (1 + n[:-1])).astype(np.float32) + np.float32(0.05)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("text")
        texts = pa.array(group["text"].tolist(), pa.string())
        x = np.concatenate([vectors(texts.slice(lo, hi - lo), idf) for lo, hi in chunks(texts)])
        c, cos = cluster(x, clusters)
        own = cos.argmax(axis=1)
        radius = [float(np.quantile(cos[own == i, i], 0.01)) - margin if (own == i).any() else 1.0 for i in range(len(c))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "k": range(len(c)), "centroid": [r.astype(float) for r in c], "radius": radius})

    model = chosen.groupBy("lang").applyInPandas(fit, "lang string, k int, centroid array<double>, radius double").toPandas()
    model = model.sort_values(["lang", "k"])
    centroids = np.array(model["centroid"].tolist(), np.float32).reshape(-1, DIMS)
    return model["lang"].tolist(), centroids, model["radius"].to_numpy(float), idf


def predicted(text: Column, model: tuple[list[str], np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """A struct of lang, score (cosine with the nearest centroid) and rejected."""
    langs, centroids, radius, idf = model

    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string())
        best, cos = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        if langs:
            for lo, hi in chunks(texts):
                x = vectors(texts.slice(lo, hi - lo), idf) @ centroids.T
                best[lo:hi] = x.argmax(axis=1)
                cos[lo:hi] = np.clip(x.max(axis=1), 0, 1)
        known = np.asarray(has_letter(texts)) & bool(langs)
        names = pa.array(langs or ["und"], pa.string()).take(pa.array(best))
        lang = pc.if_else(pa.array(known), names, pa.scalar("und"))
        score = np.where(known, cos, 0.0)
        far = known & (score < (radius[best] if langs else 0))
        return pa.StructArray.from_arrays([lang, pa.array(score), pa.array(far)], ["lang", "score", "rejected"])

    return arrow_udf(run, "lang string, score double, rejected boolean")(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """``docs`` with held_out and a struct ``language``; only rows that aren't held out are learned from."""
    bounded_batches(docs.sparkSession)
    known = docs.withColumn("held_out", held_out(F.col(doc_id)))
    rows = known.where("not held_out").select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("id"))
    return known.withColumn("language", predicted(F.col(text), learn(rows, **how)))
