"""Tag, depth and report summaries; electivity; contingency and distribution tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefpulse.operators import binning, contingency, distribution, electivity, restrict, summary, visits
from reefpulse.plans import surrogate as s
from reefpulse.plans.registry import ORACLES, query, rounded

ZONES = ["in", "out"]
ATTRIBUTES = ("release_year", "sex", "tag_model")


@query("tag_count", "SELECT count(*) AS n FROM tags")
def tag_count(spark, d):
    return summary.tag_count(s.transmitter_master(spark, d))


@query(
    "tag_freq",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS level, count(*) AS n,
                   count(*) FILTER (WHERE transmitter IN (SELECT transmitter FROM analysed)) AS n_used
            FROM tags GROUP BY {a}"""
        for a in ATTRIBUTES
    ),
)
def tag_freq(spark, d):
    return summary.tag_freq(s.transmitter_master(spark, d), s.analysed_tags(spark, d), ATTRIBUTES)


@query("depth_events", "SELECT halfhour, long_nad83, depthcat, count(*) AS n FROM depth WHERE depthcat IS NOT NULL GROUP BY ALL")
def depth_events(spark, d):
    return summary.depth_events(s.categorized_depth(spark, d))


@query(
    "depth_share",
    """SELECT round(CAST(count(*) FILTER (WHERE z < -30) AS DOUBLE) / count(*), 9) AS deep,
              round(CAST(count(*) FILTER (WHERE z > -10) AS DOUBLE) / count(*), 9) AS shallow FROM depth""",
)
def depth_share(spark, d):
    return rounded(summary.depth_share(s.categorized_depth(spark, d)))


@query(
    "status_share",
    """SELECT current_status, freq, round(freq / CAST(sum(freq) OVER () AS DOUBLE) * 100, 1) AS proptot,
              round(freq / CAST(sum(freq) FILTER (WHERE rn <= 4) OVER () AS DOUBLE) * 100, 1) AS propknown
       FROM (SELECT current_status, count(*) AS freq, row_number() OVER (ORDER BY current_status NULLS LAST) AS rn
             FROM reports GROUP BY current_status)""",
)
def status_share(spark, d):
    return summary.status_share(s.population_reports(spark, d))


@query("report_counts", "SELECT count(*) AS reports, count(DISTINCT spawning_id) AS ids FROM reports")
def report_counts(spark, d):
    return summary.report_counts(s.population_reports(spark, d))


# ---- electivity -------------------------------------------------------------


@query(
    "crosstab",
    """SELECT dafm, count(*) FILTER (WHERE pa = 'A') AS "A", count(*) FILTER (WHERE pa = 'P') AS "P"
       FROM bins WHERE dafm IS NOT NULL GROUP BY dafm""",
)
def crosstab(spark, d):
    return electivity.crosstab(s.bins(spark, d), "dafm", "pa", ["A", "P"])


@query(
    "crosstab_month",
    """SELECT month, count(*) FILTER (WHERE pa = 'A') AS "A", count(*) FILTER (WHERE pa = 'P') AS "P"
       FROM tag_months GROUP BY month""",
)
def crosstab_month(spark, d):
    return electivity.crosstab(binning.presence_by_month(s.month_bins(spark, d)), "month", "pa", ["A", "P"])


def _cells(spark, d):
    return binning.detections_by_halfhour_zone(s.located_bins(spark, d))


@query(
    "pivot_zone",
    """SELECT halfhour, max(tot_freq) FILTER (WHERE mssca = 'in') AS "in", max(tot_freq) FILTER (WHERE mssca = 'out') AS "out"
       FROM zone_cells GROUP BY halfhour""",
)
def pivot_zone(spark, d):
    return electivity.pivot_zone(_cells(spark, d))


@query(
    "chesson_presence",
    """SELECT pa, tot_freq, CAST(5e-1 AS DOUBLE) AS chesson_p, round(tot_freq / t, 9) AS prop, round(tot_freq / t / 5e-1, 9) AS rdivp,
              round(tot_freq / t, 9) AS chesson_s
       FROM (SELECT pa, count(*) AS tot_freq, CAST(sum(count(*)) OVER () AS DOUBLE) AS t FROM bins
             WHERE dafm IS NOT NULL GROUP BY pa)""",
)
def chesson_presence(spark, d):
    return rounded(electivity.chesson_presence(s.presence_table(spark, d)))


@query("availability_zone", "SELECT mssca, round(chesson_p, 9) AS chesson_p FROM availability")
def availability_zone(spark, d):
    return rounded(electivity.availability_zone(s.station_master(spark, d)))


ZONE_COUNTS = "SELECT mssca, count(*) AS tot_freq FROM bins WHERE mssca IS NOT NULL GROUP BY mssca"


@query(
    "join_availability",
    f"SELECT c.mssca, c.tot_freq, round(a.chesson_p, 9) AS chesson_p FROM ({ZONE_COUNTS}) c LEFT JOIN availability a ON a.mssca = c.mssca",
)
def join_availability(spark, d):
    bins = s.located_bins(spark, d).filter(F.col("mssca").isNotNull())
    counts = bins.groupBy("mssca").agg(F.count(F.lit(1)).alias("tot_freq"))
    return rounded(summary.join_availability(counts, electivity.availability_zone(s.station_master(spark, d))))


@query(
    "chesson_zone",
    f"""SELECT mssca, tot_freq, round(p, 9) AS chesson_p, round(prop, 9) AS prop, round(prop / p, 9) AS rdivp,
               round(prop / p / sum(prop / p) OVER (), 9) AS chesson_s
        FROM (SELECT c.mssca, c.tot_freq, a.chesson_p AS p, tot_freq / CAST(sum(tot_freq) OVER () AS DOUBLE) AS prop
              FROM ({ZONE_COUNTS}) c LEFT JOIN availability a ON a.mssca = c.mssca)""",
)
def chesson_zone(spark, d):
    return rounded(electivity.chesson_zone(s.located_bins(spark, d), s.station_master(spark, d)))


@query(
    "chesson_halfhour",
    """SELECT halfhour, mssca, tot_freq, round(s, 9) AS chesson_s, round(1e0 / count(*) OVER (), 9) AS expected
       FROM halfhour_index""",
)
def chesson_halfhour(spark, d):
    index = electivity.chesson_halfhour(_cells(spark, d), s.station_master(spark, d))
    return rounded(index.select("halfhour", "mssca", "tot_freq", "chesson_s", "expected")).orderBy(
        F.desc("chesson_s"), "halfhour", "mssca"
    )


@query(
    "chesson_month",
    """SELECT month, a AS "A", p AS "P", a + p AS tot_freq, round((a + p) / t, 9) AS chesson_p, round(p / t, 9) AS prop,
              round(p / t / ((a + p) / t), 9) AS rdivp,
              round(p / t / ((a + p) / t) / sum(p / t / ((a + p) / t)) OVER (), 9) AS chesson_s,
              CAST(month(strptime(month || ' 1 2000', '%b %d %Y')) AS INTEGER) AS month_no
       FROM (SELECT month, count(*) FILTER (WHERE pa = 'A') AS a, count(*) FILTER (WHERE pa = 'P') AS p,
                    CAST(sum(count(*)) OVER () AS DOUBLE) AS t FROM tag_months GROUP BY month)""",
)
def chesson_month(spark, d):
    return rounded(electivity.chesson_month(binning.presence_by_month(s.month_bins(spark, d))))


@query(
    "chesson_dafm",
    """SELECT dafm, round(chesson_p, 9) AS chesson_p, round(chesson_s, 9) AS chesson_s, round(chesson_s_abs, 9) AS chesson_s_abs
       FROM dafm_index""",
)
def chesson_dafm(spark, d):
    return rounded(electivity.chesson_dafm(s.presence_table(spark, d))).orderBy(F.desc("chesson_s"), "dafm")


@query(
    "chesson_station",
    """SELECT station, mssca, round(p, 9) AS chesson_p, n AS tot_freq, round(prop, 9) AS prop, round(prop / p, 9) AS rdivp,
              round(prop / p / sum(prop / p) OVER (), 9) AS chesson_s
       FROM (SELECT s.station, s.mssca, CAST(s.years_deployed AS DOUBLE) / sum(s.years_deployed) OVER () AS p,
                    coalesce(c.n, 0) AS n, coalesce(c.n, 0) / CAST(sum(c.n) OVER () AS DOUBLE) AS prop
             FROM stations s LEFT JOIN (SELECT station, count(*) AS n FROM det_short GROUP BY station) c ON c.station = s.station)""",
)
def chesson_station(spark, d):
    return rounded(electivity.chesson_station(s.detections_short(spark, d), s.station_master(spark, d)))


@query(
    "chesson_station_given",
    """SELECT station, mssca, round(p, 9) AS chesson_p, n AS tot_freq, round(prop, 9) AS prop, round(prop / p, 9) AS rdivp,
              round(prop / p / sum(prop / p) OVER (), 9) AS chesson_s
       FROM (SELECT s.station, s.mssca,
                    coalesce(CASE WHEN years_deployed > 1 THEN years_deployed / 1e3 END,
                             CAST(s.years_deployed AS DOUBLE) / sum(s.years_deployed) OVER ()) AS p,
                    coalesce(c.n, 0) AS n, coalesce(c.n, 0) / CAST(sum(c.n) OVER () AS DOUBLE) AS prop
             FROM stations s LEFT JOIN (SELECT station, count(*) AS n FROM det_short GROUP BY station) c ON c.station = s.station)""",
)
def chesson_station_given(spark, d):
    """Availability from the station table, by years deployed where it has none."""
    own = F.when(F.col("years_deployed") > 1, F.col("years_deployed") / F.lit(1000.0))
    stations = s.station_master(spark, d).withColumn("chesson_p", own)
    return rounded(electivity.chesson_station(s.detections_short(spark, d), stations))


@query(
    "unpivot_index",
    """SELECT dafm, 'chesson_s' AS type, round(chesson_s, 9) AS value FROM dafm_index
       UNION ALL SELECT dafm, 'chesson_s_abs', round(chesson_s_abs, 9) FROM dafm_index
       UNION ALL SELECT dafm, 'chesson_p', round(chesson_p, 9) FROM dafm_index""",
)
def unpivot_index(spark, d):
    return rounded(electivity.unpivot_index(electivity.chesson_dafm(s.presence_table(spark, d))))


# ---- contingency ------------------------------------------------------------


def _full(spark, d):
    return contingency.contingency_table(_cells(spark, d), "halfhour", "mssca", "tot_freq", ZONES)


CHI_SQL = """
SELECT round(sum((o - e) ** 2 / e), 6) AS statistic, (count(DISTINCT halfhour) - 1) * (count(DISTINCT mssca) - 1) AS df
FROM expected
"""


@query("chi_square", CHI_SQL)
def chi_square(spark, d):
    return rounded(contingency.chi_square(_full(spark, d), ZONES), 6)


@query(
    "chi_square_index",
    """SELECT round(sum((o - e) ** 2 / e), 6) AS statistic, (count(DISTINCT halfhour) - 1) * (count(DISTINCT mssca) - 1) AS df
       FROM (SELECT halfhour, mssca, o, sum(o) OVER (PARTITION BY halfhour) * sum(o) OVER (PARTITION BY mssca) / sum(o) OVER () AS e
             FROM (SELECT h.halfhour, z.mssca, coalesce(i.s, 0) * 96 AS o
                   FROM (SELECT DISTINCT halfhour FROM halfhour_index) h CROSS JOIN (VALUES ('in'), ('out')) z(mssca)
                   LEFT JOIN halfhour_index i ON i.halfhour = h.halfhour AND i.mssca = z.mssca))""",
)
def chi_square_index(spark, d):
    index = electivity.chesson_halfhour(_cells(spark, d), s.station_master(spark, d))
    scaled = index.withColumn("s96", F.col("chesson_s") * 96.0)
    cells = contingency.contingency_table(scaled, "halfhour", "mssca", "s96", ZONES)
    return rounded(contingency.chi_square(cells, ZONES), 6)


@query(
    "chi_square_corrected",
    """SELECT round(sum((abs(o - e) - least(5e-1, m)) ** 2 / e), 6) AS statistic, CAST(1 AS BIGINT) AS df
       FROM (SELECT *, min(abs(o - e)) OVER () AS m
             FROM (SELECT fish, depthcat, o, sum(o) OVER (PARTITION BY fish) * sum(o) OVER (PARTITION BY depthcat) / sum(o) OVER () AS e
                   FROM (SELECT fish, depthcat, CAST(count(*) AS DOUBLE) AS o FROM depth WHERE depthcat IS NOT NULL GROUP BY ALL)))""",
)
def chi_square_corrected(spark, d):
    """A 2 x 2 table: fish group against depth class."""
    depth = s.categorized_depth(spark, d).filter(F.col("depthcat").isNotNull())
    counts = depth.groupBy("fish", "depthcat").agg(F.count(F.lit(1)).alias("n"))
    levels = ["deep", "shallow"]
    cells = contingency.contingency_table(counts, "fish", "depthcat", "n", levels)
    return rounded(contingency.chi_square(cells, levels), 6)


@query(
    "g_statistic",
    """SELECT round(2 * sum(CASE WHEN o > 0 THEN o * ln(o / e) ELSE 0 END), 6) AS statistic,
              (count(DISTINCT halfhour) - 1) * (count(DISTINCT mssca) - 1) AS df FROM expected""",
)
def g_statistic(spark, d):
    return rounded(contingency.g_statistic(_full(spark, d), ZONES), 6)


@query(
    "mosaic_share",
    "SELECT halfhour, mssca, tot_freq, round(tot_freq / CAST(sum(tot_freq) OVER (PARTITION BY halfhour) AS DOUBLE), 9) AS share FROM zone_cells",
)
def mosaic_share(spark, d):
    return rounded(electivity.mosaic_share(_cells(spark, d), "halfhour", "mssca"))


# ---- distributions ----------------------------------------------------------

SIX_SQL = """
SELECT {by} round(CAST(min({x}) AS DOUBLE), 9) AS min, round(quantile_cont(CAST({x} AS DOUBLE), 0.25), 9) AS q1,
       round(quantile_cont(CAST({x} AS DOUBLE), 0.5), 9) AS median, round(avg({x}), 9) AS mean,
       round(quantile_cont(CAST({x} AS DOUBLE), 0.75), 9) AS q3, round(CAST(max({x}) AS DOUBLE), 9) AS max,
       count(*) - count({x}) AS nulls FROM {source} GROUP BY ALL
"""


@query("six_number", SIX_SQL.format(by="", x="z", source="depth"))
def six_number(spark, d):
    return rounded(distribution.six_number(s.categorized_depth(spark, d), "z"))


@query("six_number_by_fish", SIX_SQL.format(by="fish,", x="z", source="depth"))
def six_number_by_fish(spark, d):
    return rounded(distribution.six_number(s.categorized_depth(spark, d), "z", ["fish"]))


@query("six_number_length", SIX_SQL.format(by="", x="tl", source="tags"))
def six_number_length(spark, d):
    return rounded(distribution.six_number(s.transmitter_master(spark, d), "tl"))


@query("six_number_dates", SIX_SQL.format(by="", x="(release_date - DATE '1970-01-01')", source="tags"))
def six_number_dates(spark, d):
    return rounded(distribution.six_number_dates(s.transmitter_master(spark, d), "release_date"))


@query(
    "sem",
    """SELECT fish, count(*) AS n, round(stddev_samp(z), 9) AS sd, round(stddev_samp(z) / sqrt(count(*)), 9) AS sem
       FROM depth GROUP BY fish""",
)
def sem(spark, d):
    return rounded(distribution.sem(s.categorized_depth(spark, d), "z", ["fish"]))


@query(
    "sem_length",
    """SELECT count(tl) AS n, round(stddev_samp(tl), 9) AS sd, round(stddev_samp(tl) / sqrt(count(tl)), 9) AS sem FROM tags""",
)
def sem_length(spark, d):
    return rounded(distribution.sem(s.transmitter_master(spark, d), "tl", skip_null=True))


HIST_SQL = """
WITH w AS (SELECT {width} AS w, floor((min({x}) - {width} / 2) / {width}) + 1 AS first,
                  greatest(ceil((max({x}) - {width} / 2) / {width} - 1e-8), floor((min({x}) - {width} / 2) / {width}) + 1) AS last
           FROM {source})
SELECT {by} g.bin * w AS center, (g.bin - 5e-1) * w AS xmin, (g.bin + 5e-1) * w AS xmax, coalesce(c.n, 0) AS n
FROM (SELECT {groups} w, unnest(generate_series(CAST(first AS BIGINT), CAST(last AS BIGINT))) AS bin FROM w {cross}) g
LEFT JOIN (SELECT {own} CAST(greatest(ceil(({x} - w / 2) / w - 1e-8), first) AS BIGINT) AS bin, count(*) AS n
           FROM {source} CROSS JOIN w WHERE {x} IS NOT NULL GROUP BY ALL) c ON c.bin = g.bin {same}
"""


def _round_edges(sql: str) -> str:
    return f"SELECT * REPLACE (round(center, 9) AS center, round(xmin, 9) AS xmin, round(xmax, 9) AS xmax) FROM ({sql})"


@query(
    "histogram",
    _round_edges(
        HIST_SQL.format(width="((max(z) - min(z)) / 29)", x="z", source="depth", by="", groups="", cross="", own="", same="")
    ),
)
def histogram(spark, d):
    return rounded(distribution.histogram(s.categorized_depth(spark, d), "z"))


@query(
    "histogram_length_by_sex",
    _round_edges(
        HIST_SQL.format(
            width="2e0", x="tl", source="tags", by="g.sex,", groups="sex,",
            cross="CROSS JOIN (SELECT DISTINCT sex FROM tags WHERE tl IS NOT NULL)", own="sex,", same="AND c.sex = g.sex",
        )
    ),
)
def histogram_length_by_sex(spark, d):
    return rounded(distribution.histogram(s.transmitter_master(spark, d), "tl", ["sex"], width=2.0))


@query(
    "histogram_trips",
    _round_edges(HIST_SQL.format(width="1e0", x="trips", source="strict", by="", groups="", cross="", own="", same="")),
)
def histogram_trips(spark, d):
    days = visits.visit_days(restrict.split_datetime(s.detections_long(spark, d)))
    return rounded(distribution.histogram(visits.trips_strict(days), "trips", width=1.0))


@query(
    "histogram_by_fish",
    _round_edges(
        HIST_SQL.format(
            width="((max(z) - min(z)) / 29)", x="z", source="depth", by="g.fish,", groups="fish,",
            cross="CROSS JOIN (SELECT DISTINCT fish FROM depth)", own="fish,", same="AND c.fish = g.fish",
        )
    ),
)
def histogram_by_fish(spark, d):
    return rounded(distribution.histogram(s.categorized_depth(spark, d), "z", ["fish"]))


@query(
    "histogram_absences",
    _round_edges(
        HIST_SQL.format(
            width="((max(absdays) - min(absdays)) / 29e0)", x="absdays", source="gaps", by="", groups="", cross="", own="", same=""
        )
    ),
)
def histogram_absences(spark, d):
    days = visits.visit_days(restrict.split_datetime(s.detections_long(spark, d)))
    return rounded(distribution.histogram(visits.absences(days), "absdays"))


@query(
    "six_number_trips_per_year",
    SIX_SQL.format(
        by="", x="trips",
        source="(SELECT count(*) AS trips FROM gaps GROUP BY transmitter, year(last_date))",
    ),
)
def six_number_trips_per_year(spark, d):
    days = visits.visit_days(restrict.split_datetime(s.detections_long(spark, d)))
    by_year = visits.trips_by_year(days, days).filter(F.col("trips") != 0)
    return rounded(distribution.six_number(by_year, "trips"))


@query(
    "levene",
    """SELECT k - 1 AS df1, n - k AS df2, round(between_ss / (k - 1) / (within_ss / (n - k)), 6) AS f
       FROM (SELECT count(DISTINCT fish) AS k, count(*) AS n, sum((m - g) ** 2) AS between_ss, sum((dev - m) ** 2) AS within_ss
             FROM (SELECT *, avg(dev) OVER (PARTITION BY fish) AS m, avg(dev) OVER () AS g
                   FROM (SELECT d.fish, abs(d.z - q.med) AS dev FROM depth d
                         JOIN (SELECT fish, quantile_cont(z, 0.5) AS med FROM depth GROUP BY fish) q ON q.fish = d.fish)))""",
)
def levene(spark, d):
    return rounded(distribution.levene(s.categorized_depth(spark, d), "z", "fish"), 6)


@query(
    "rank_sum",
    """SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, w,
              round((w - n1 * n2 / 2 - sign(w - n1 * n2 / 2) * 5e-1)
                    / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 9) AS z
       FROM (SELECT CAST(count(*) FILTER (WHERE fish = 'even') AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE fish <> 'even') AS DOUBLE) AS n2,
                    sum(r) FILTER (WHERE fish = 'even')
                      - count(*) FILTER (WHERE fish = 'even') * (count(*) FILTER (WHERE fish = 'even') + 1) / 2e0 AS w,
                    sum(CAST(c AS DOUBLE) ** 2 - 1) AS ties
             FROM (SELECT fish, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2e0 AS r,
                          count(*) OVER (PARTITION BY z) AS c FROM depth))""",
)
def rank_sum(spark, d):
    return rounded(distribution.rank_sum(s.categorized_depth(spark, d), "z", "fish", "even"))


# Tails as sums of positive terms: the lower gamma, and the short side of the F.
_GAMMA_TAIL = "1 - (SELECT sum(exp(({a} + k) * ln({x}) - {x} - lgamma({a} + k + 1))) FROM range(0, 4000) r(k))"
_F_TAIL = """1 - (SELECT sum(exp(lgamma((df1 + df2) / 2e0 + k) - lgamma(df1 / 2e0 + k + 1) - lgamma(df2 / 2e0)
                 + (df1 / 2e0 + k) * ln(y) + df2 / 2e0 * ln(1 - y))) FROM range(0, 4000) r(k))"""


def _p_values_sql() -> str:
    def from_gamma(name: str, key: str, stat: str, a: str, x: str) -> str:
        return f"SELECT '{name}' AS test, {stat} AS statistic, {_GAMMA_TAIL.format(a=a, x=x)} AS p FROM ({ORACLES[key]})"

    def from_f(name: str, key: str, df1: str, df2: str) -> str:
        inner = f"SELECT f, {df1} AS df1, {df2} AS df2 FROM ({ORACLES[key]})"
        return f"SELECT '{name}', f, {_F_TAIL} FROM (SELECT *, df1 * f / (df2 + df1 * f) AS y FROM ({inner}))"

    parts = [
        from_gamma("chi_square", "chi_square", "statistic", "(df / 2e0)", "(statistic / 2e0)"),
        from_gamma("g", "g_statistic", "statistic", "(df / 2e0)", "(statistic / 2e0)"),
        from_f("levene", "levene", "df1", "df2"),
        from_gamma("rank_sum", "rank_sum", "z", "5e-1", "(z * z / 2e0)"),
        from_f("linear_fit", "linear_fit", "1", "(n - 2)"),
    ]
    return f"SELECT test, statistic, round(p, 9) AS p_value FROM ({' UNION ALL '.join(parts)})"


@query("test_p_values", _p_values_sql)
def test_p_values(spark, d):
    """Tail probabilities of the tests above, from statistics as those report them."""
    depth, cells = s.categorized_depth(spark, d), _full(spark, d)
    trips = visits.trip_lengths(visits.visit_days(restrict.split_datetime(s.detections_long(spark, d))))
    fit = distribution.linear_fit(trips, "triplen", "monthnum")
    parts = {
        "chi_square": contingency.with_p(rounded(contingency.chi_square(cells, ZONES), 6)),
        "g": contingency.with_p(rounded(contingency.g_statistic(cells, ZONES), 6)),
        "levene": distribution.levene_p(rounded(distribution.levene(depth, "z", "fish"), 6)).withColumnRenamed("f", "statistic"),
        "rank_sum": distribution.rank_sum_p(rounded(distribution.rank_sum(depth, "z", "fish", "even"))).withColumnRenamed("z", "statistic"),
        "linear_fit": distribution.linear_fit_p(rounded(fit, 6)).withColumnRenamed("f", "statistic"),
    }
    out = None
    for name, part in parts.items():
        row = part.select(F.lit(name).alias("test"), "statistic", "p_value")
        out = row if out is None else out.unionByName(row)
    return rounded(out)
