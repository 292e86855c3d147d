"""Small tables for edge cases, and plain-Python counterparts."""

from __future__ import annotations

import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return SPACE.findall(text or "")


def prose(seed: int, n: int) -> str:
    """n words that follow from the seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append("w" + format(x >> 50, "x"))
    return " ".join(out)


def docs(spark, rows):
    """Rows of (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    """Nulls, empty and very long texts, repeated rows."""
    long = prose(99, 30_000)
    return [
        (1, None, None, None), (2, "", "en", None), (3, " \t\n ", None, "s"), (None, prose(1, 80), "en", "s"), (None, prose(1, 80), "en", "s"),
        (5, prose(1, 80), "en", "s"), (5, prose(1, 80), "en", "s"), (6, long, "en", "s"), (7, "one", "en", "t"), (8, long + " tail", "en", "s"),
    ]


def with_clashes(df):
    """Extra columns named as operators' inner ones."""
    from pyspark.sql import functions as F

    names = ["d", "fp", "a", "id", "n", "size", "key", "root", "row", "count", "host", "word", "unit", "x", "label"]
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names) if c not in df.columns])
