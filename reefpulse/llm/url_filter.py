"""URL filter: ratio of two character language models, with DataFrame functions only.

Host and path are read as characters of 32 classes. One Markov model is counted over
accepted and one over rejected URLs, on all labelled rows but a quarter kept for
calibration. Orders vary: a character's probability after the two before it is
smoothed by that after the one before, and that by its frequency; contexts seen
fewer than ``least_seen`` times are left to the shorter one. A URL's score is the
mean over its characters of the log-likelihood difference; the threshold is the one
that parts the labelled URLs kept aside best (largest sum of both hit rates).

Both models fold into one array of 32 ** 3 differences, of fixed size whatever the
input, which the planner reads once as a scalar subquery. Counting is one
aggregation with at most 32 ** 3 keys, so no host or URL is ever a hot key.

Defined results: an empty table gives an empty result; a null URL, or one without ``://``, has empty host and path, matches
no rule and scores the end mark alone; without labels of both kinds every difference
and the threshold are 0, and a score of 0 or more is accepted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reefpulse.llm.store import stored

# Classes 1 to 30 by place in this text; 0 marks start and end, 31 is any other character.
CLASSES = "abcdefghijklmnopqrstuvwxyz0-./"
N = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The (rule, verdict) that fits: its host or a subdomain, its path a prefix; the longest wins.

    ``rules`` are pairs of verdict and rule, such as ("block", "example.com/de/").
    """
    def fits(rule: str) -> Column:
        at, _, rest = rule.partition("/")
        return ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")

    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    return F.coalesce(
        *[F.when(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(v).alias("verdict"))) for v, rule in ranked],
        F.lit(None).cast("struct<rule:string,verdict:string>"),
    )


def character_classes(text: Column) -> Column:
    """The classes of a text's characters, ending with the end mark."""
    folded = F.translate(F.translate(text, UPPER, LOWER), "123456789", "000000000")
    place = F.transform(
        F.filter(F.split(folded, ""), lambda x: x != ""),
        lambda x: F.coalesce(F.nullif(F.instr(F.lit(CLASSES), x), F.lit(0)), F.lit(31)),
    )
    return F.concat(place, F.array(F.lit(0)))


def _grams(classes: Column) -> Column:
    """Codes of each class with the two before it."""
    padded = F.concat(F.array(F.lit(0), F.lit(0)), classes)
    pair = F.zip_with(padded, F.slice(padded, F.lit(2), F.size(padded)), lambda a, b: a * N + b)
    return F.zip_with(F.slice(pair, F.lit(1), F.size(classes)), classes, lambda ab, c: ab * N + c)


def log_ratios(labelled: DataFrame, smoothing: float = 4.0, least_seen: int = 4) -> DataFrame:
    """One row: ``ratios``, by gram code the log-probability under accepted less that under rejected.

    ``labelled`` has ``grams`` (array of codes) and ``accept`` (boolean).
    """
    spark = labelled.sparkSession
    counted = (
        labelled.select("accept", F.explode("grams").alias("code"))
        .groupBy("code")
        .agg(F.count_if(F.col("accept")).alias("yes"), F.count_if(~F.col("accept")).alias("no"))
    )
    code = F.col("code")
    grid = spark.range(N**3).select(F.col("id").cast("int").alias("code")).join(counted, "code", "left").fillna(0)
    after_one, one, last = F.pmod(code, F.lit(N * N)), F.expr(f"pmod(code, {N * N}) div {N}"), F.pmod(code, F.lit(N))
    grid = grid.select("*", after_one.alias("two"), F.expr(f"code div {N}").alias("before"), one.alias("one"), last.alias("last"))

    def log_p(n: str) -> Column:
        def total(*keys: str) -> Column:
            return F.sum(n).over(W.partitionBy(*keys)).cast("double")

        p1 = (total("last") + 1) / (total(F.lit(0)) + N)
        p2 = (total("two") + smoothing * p1) / (total("one") + smoothing)
        p3 = (F.col(n) + smoothing * p2) / (total("before") + smoothing)
        return F.log(F.when(total("before") >= least_seen, p3).otherwise(p2))

    both = (F.sum("yes").over(W.partitionBy(F.lit(0))) > 0) & (F.sum("no").over(W.partitionBy(F.lit(0))) > 0)
    ratio = F.when(both, log_p("yes") - log_p("no")).otherwise(0.0)
    rows = grid.select("code", ratio.alias("ratio"))
    return rows.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("code", "ratio"))), lambda x: x["ratio"]).alias("ratios")
    )


def mean_ratio(classes: Column, ratios: Column) -> Column:
    """The mean of a text's differences: one step a character, with the two classes before it as state."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    total = F.aggregate(
        classes, start,
        lambda t, c: F.struct(
            (t["s"] + F.get(ratios, (t["a"] * N + t["b"]) * N + c)).alias("s"), t["b"].alias("a"), c.alias("b")
        ),
        lambda t: t["s"],
    )
    return total / F.size(classes)


def best_threshold(scored: DataFrame, step: float = 0.01) -> DataFrame:
    """One row: ``threshold``, the multiple of ``step`` that parts ``score`` by ``accept`` best.

    Scores are counted in bins first; only bins (bounded by the range of the
    differences over ``step``) are ordered.
    """
    bins = scored.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(
        F.count_if(F.col("accept")).alias("yes"), F.count_if(~F.col("accept")).alias("no")
    )
    upward = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    below_no, below_yes = (F.coalesce(F.sum(c).over(upward), F.lit(0)) for c in ("no", "yes"))
    all_no, all_yes = F.sum("no").over(every), F.sum("yes").over(every)
    gain = F.when((all_no > 0) & (all_yes > 0), below_no / all_no - below_yes / all_yes)
    best = bins.select((F.col("bin") * step).alias("at"), gain.alias("gain")).where("gain is not null")
    return best.agg(F.coalesce(F.max_by("at", F.struct("gain", -F.abs("at"))), F.lit(0.0)).alias("threshold"))


def kept_aside(host: Column, path: Column) -> Column:
    """A quarter of all URLs, by hash."""
    return F.pmod(F.xxhash64(host, path), F.lit(4)) == 0


def judge_urls(
    pages: DataFrame, url: str, rules: Sequence[tuple[str, str]], reject_words: Sequence[str] = (),
    smoothing: float = 4.0, least_seen: int = 4,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score.

    Rules decide where one fits, and label the URLs that train the models. A URL
    without a rule counts as rejected in training if its host has one of
    ``reject_words`` between dots and hyphens. The models decide every URL that no
    rule does. Columns of those names are replaced.
    """
    known = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    known = known.withColumn("__rule", longest_rule(F.col("host"), F.col("path"), rules))
    known = known.withColumn("__classes", character_classes(F.concat("host", "path")))
    words = "|".join(reject_words)
    seeded = F.col("host").rlike(rf"(^|[.-])({words})([.-]|$)") if words else F.lit(False)
    label = F.when(F.col("__rule").isNotNull(), F.col("__rule.verdict") == "allow").when(seeded, F.lit(False))
    labelled = known.select(
        label.alias("accept"), F.col("__classes").alias("classes"),
        kept_aside(F.col("host"), F.col("path")).alias("aside"),
    ).where("accept is not null")
    ratios = stored(
        log_ratios(labelled.where("not aside").select("accept", _grams(F.col("classes")).alias("grams")), smoothing, least_seen),
        "ratios",
    )
    calibration = labelled.where("aside").withColumn("ratios", ratios.scalar()).select(
        "accept", mean_ratio(F.col("classes"), F.col("ratios")).alias("score")
    )
    threshold = stored(best_threshold(calibration), "threshold")
    scored = known.withColumn("__ratios", ratios.scalar())
    scored = scored.withColumn("score", mean_ratio(F.col("__classes"), F.col("__ratios"))).drop("__ratios")
    own = F.when(F.col("score") >= threshold.scalar(), F.lit("allow")).otherwise(F.lit("block"))
    return scored.withColumns(
        {"rule": F.col("__rule.rule"), "verdict": F.coalesce(F.col("__rule.verdict"), own)}
    ).drop("__rule", "__classes")
