"""DAFM, moon cycles, trips, absences and attendance."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefpulse.operators import distribution, lunar, restrict, summary, visits
from reefpulse.plans import surrogate as s
from reefpulse.plans.registry import query, rounded

def _days(spark, d):
    return visits.visit_days(restrict.split_datetime(s.detections_long(spark, d)))


def _trips(spark, d):
    return visits.trip_lengths(_days(spark, d))


def _by_dafm(spark, d):
    return lunar.detections_by_dafm(restrict.month_parts(s.dated_long(spark, d)))


@query("dafm", "SELECT event_id, date, dafm FROM dated_long")
def dafm(spark, d):
    return s.dated_long(spark, d).select("event_id", "date", "dafm")


@query("moon_cycle", "SELECT event_id, dafm, date - dafm AS moondate FROM dated_long")
def moon_cycle(spark, d):
    return lunar.add_moon_cycle(s.dated_long(spark, d)).select("event_id", "dafm", "moondate")


@query("detections_by_dafm", "SELECT * FROM by_dafm")
def detections_by_dafm(spark, d):
    return _by_dafm(spark, d).orderBy(F.desc("detfreq"), "transmitter", "year", "monthint", "dafm")


INDIVIDUALS = """
SELECT year, monthint, monthname, dafm, count(DISTINCT transmitter) AS no_inds, CAST(sum(detfreq) AS BIGINT) AS no_dets
FROM by_dafm {where} GROUP BY ALL
"""


@query("individuals_by_dafm", INDIVIDUALS.format(where=""))
def individuals_by_dafm(spark, d):
    return lunar.individuals_by_dafm(_by_dafm(spark, d))


@query("individuals_by_dafm_after", INDIVIDUALS.format(where="WHERE year > 1995"))
def individuals_by_dafm_after(spark, d):
    return lunar.individuals_by_dafm(_by_dafm(spark, d), after_year=1995)


@query("month_peak", "SELECT monthint, CAST(sum(detfreq) AS BIGINT) AS dets FROM by_dafm GROUP BY monthint")
def month_peak(spark, d):
    return lunar.month_peak(_by_dafm(spark, d)).orderBy(F.desc("dets"), "monthint")


@query("month_range", "SELECT min(monthint) AS first_month, max(monthint) AS last_month FROM by_dafm")
def month_range(spark, d):
    return _by_dafm(spark, d).agg(F.min("monthint").alias("first_month"), F.max("monthint").alias("last_month"))


@query("late_stayers", "SELECT * FROM by_dafm WHERE dafm > 14")
def late_stayers(spark, d):
    return lunar.late_stayers(_by_dafm(spark, d))


@query("late_month_tags", "SELECT DISTINCT transmitter FROM by_dafm WHERE monthint > 8")
def late_month_tags(spark, d):
    return lunar.late_month_tags(_by_dafm(spark, d))


ARRIVE = """
SELECT transmitter, date - dafm AS moondate, min(dafm) AS arrival, max(dafm) AS departure
FROM (SELECT DISTINCT transmitter, date, dafm FROM dated_long) GROUP BY ALL
"""


@query("arrive_depart", ARRIVE)
def arrive_depart(spark, d):
    return lunar.arrive_depart(s.dated_long(spark, d))


@query(
    "arrive_depart_summary",
    f"""SELECT moondate, round(avg(arrival), 9) AS meanarrive, round(avg(departure), 9) AS meandepart, count(*) AS n,
               round(stddev_samp(arrival), 9) AS sdarrive, round(stddev_samp(departure), 9) AS sddepart,
               round(stddev_samp(arrival) / sqrt(count(*)), 9) AS semarrive,
               round(stddev_samp(departure) / sqrt(count(*)), 9) AS semdepart
        FROM ({ARRIVE}) GROUP BY moondate""",
)
def arrive_depart_summary(spark, d):
    return rounded(lunar.arrive_depart_summary(lunar.arrive_depart(s.dated_long(spark, d))))


@query("trips_strict", "SELECT * FROM strict")
def trips_strict(spark, d):
    return visits.trips_strict(_days(spark, d))


@query("absences", "SELECT * FROM gaps")
def absences(spark, d):
    return visits.absences(_days(spark, d))


@query(
    "trips_by_year",
    """SELECT t.transmitter, t.year, coalesce(g.n, 0) AS trips
       FROM (SELECT DISTINCT transmitter, CAST(year(date) AS INTEGER) AS year FROM days_long) t
       LEFT JOIN (SELECT transmitter, year(last_date) AS year, count(*) AS n FROM gaps GROUP BY ALL) g
         ON g.transmitter = t.transmitter AND g.year = t.year""",
)
def trips_by_year(spark, d):
    days = _days(spark, d)
    return visits.trips_by_year(days, days)


@query("trip_lengths", "SELECT * FROM trips")
def trip_lengths(spark, d):
    return _trips(spark, d)


@query(
    "trip_lengths_all",
    """SELECT transmitter, CAST(year(last_date) AS INTEGER) AS year, CAST(month(last_date) AS INTEGER) AS monthnum,
              tripnum, triplen, abslen FROM all_trips""",
)
def trip_lengths_all(spark, d):
    return visits.trip_lengths(_days(spark, d), include_last=True)


@query(
    "last_before_gap",
    """SELECT p.transmitter, p.event_id, p.station, p.long_nad83, p.lat_nad83, CAST(g.grp AS BIGINT) AS "group"
       FROM (SELECT *, row_number() OVER (PARTITION BY transmitter ORDER BY detection_time_ast, station, event_id) AS pos FROM det_long) p
       JOIN (SELECT transmitter, pos, row_number() OVER (PARTITION BY transmitter ORDER BY pos) AS grp
             FROM (SELECT transmitter, detection_time_ast AS t,
                          lead(detection_time_ast) OVER (PARTITION BY transmitter ORDER BY detection_time_ast, station, event_id) AS nxt,
                          row_number() OVER (PARTITION BY transmitter ORDER BY detection_time_ast, station, event_id) AS pos
                   FROM det_long) WHERE epoch_us(nxt) - epoch_us(t) > 604800000000) g
         ON g.transmitter = p.transmitter AND p.pos BETWEEN g.pos - 4 AND g.pos""",
)
def last_before_gap(spark, d):
    rows = visits.last_before_gap(s.detections_long(spark, d), ties=("station", "event_id"))
    return rows.select("transmitter", "event_id", "station", "long_nad83", "lat_nad83", "group")


@query(
    "absence_split",
    """SELECT absence, CAST(min(abslen) AS DOUBLE) AS min, quantile_cont(CAST(abslen AS DOUBLE), 0.25) AS q1,
              quantile_cont(CAST(abslen AS DOUBLE), 0.5) AS median, round(avg(abslen), 9) AS mean,
              quantile_cont(CAST(abslen AS DOUBLE), 0.75) AS q3, CAST(max(abslen) AS DOUBLE) AS max, CAST(0 AS BIGINT) AS nulls
       FROM (SELECT abslen, CASE WHEN abslen > 7 AND abslen < 40 THEN 'within' WHEN abslen > 40 THEN 'between' END AS absence FROM trips)
       WHERE absence IS NOT NULL GROUP BY absence""",
)
def absence_split(spark, d):
    return rounded(distribution.six_number(visits.absence_split(_trips(spark, d)), "abslen", ["absence"]))


STATS_SQL = """
SELECT count({x}) AS n, min({x}) AS min, round(quantile_cont(CAST({x} AS DOUBLE), 0.5), 9) AS median, round(avg({x}), 9) AS mean,
       max({x}) AS max, round(stddev_samp({x}) / sqrt(count({x})), 9) AS sem FROM {source}
"""


@query(
    "trip_stats",
    """SELECT round(quantile_cont(CAST(trips AS DOUBLE), 0.5), 9) AS median_trips, count(*) FILTER (WHERE trips = 1) AS single,
              round(avg(trips) FILTER (WHERE trips <> 1), 9) AS mean_multi,
              round(stddev_samp(trips) FILTER (WHERE trips <> 1) / sqrt(count(*) FILTER (WHERE trips <> 1)), 9) AS sem_multi
       FROM strict""",
)
def trip_stats(spark, d):
    return rounded(visits.trip_stats(visits.trips_strict(_days(spark, d))))


@query("absence_stats", STATS_SQL.format(x="absdays", source="gaps"))
def absence_stats(spark, d):
    return rounded(visits.spread_of(visits.absences(_days(spark, d)), "absdays"))


@query(
    "trips_per_year_stats",
    STATS_SQL.format(
        x="trips",
        source="(SELECT count(*) AS trips FROM gaps GROUP BY transmitter, year(last_date))",
    ),
)
def trips_per_year_stats(spark, d):
    days = _days(spark, d)
    return rounded(visits.spread_of(visits.trips_by_year(days, days).filter(F.col("trips") != 0), "trips"))


@query("trip_length_stats", STATS_SQL.format(x="triplen", source="trips"))
def trip_length_stats(spark, d):
    return rounded(visits.spread_of(_trips(spark, d), "triplen"))


@query(
    "trip_length_by_month",
    """SELECT monthnum, round(avg(triplen), 9) AS meanlen, round(stddev_samp(triplen), 9) AS sdlen, count(*) AS nlen,
              round(stddev_samp(triplen) / sqrt(count(*)), 9) AS semlen FROM trips GROUP BY monthnum""",
)
def trip_length_by_month(spark, d):
    return rounded(visits.trip_length_by_month(_trips(spark, d)))


@query("attendance", "SELECT * FROM attend")
def attendance(spark, d):
    return visits.attendance(s.dated_long(spark, d))


@query(
    "fish_attendance_join",
    """SELECT t.transmitter, t.release_year, t.release_site, t.tl, t.sex, coalesce(a.no_days, 0) AS no_days,
              coalesce(a.no_months, 0) AS no_months, coalesce(a.no_years, 0) AS no_years
       FROM tags t LEFT JOIN attend a ON a.transmitter = t.transmitter""",
)
def fish_attendance_join(spark, d):
    fish = s.transmitter_master(spark, d).select("transmitter", "release_year", "release_site", "tl", "sex")
    return visits.fish_attendance(fish, visits.attendance(s.dated_long(spark, d)))


@query(
    "returners",
    """SELECT count(*) FILTER (WHERE no_days > 1) AS returndays, count(*) FILTER (WHERE no_months > 1) AS returnmonths,
              count(*) FILTER (WHERE no_years > 1) AS returnyears,
              round(avg(no_months) FILTER (WHERE no_months > 1), 9) AS mean_months,
              round(stddev_samp(no_months) FILTER (WHERE no_months > 1), 9) AS sd_months FROM attend""",
)
def returners(spark, d):
    return rounded(visits.returners(visits.attendance(s.dated_long(spark, d))))


@query("returners_listing", "SELECT * FROM attend WHERE no_months > 1")
def returners_listing(spark, d):
    seen = visits.attendance(s.dated_long(spark, d))
    return seen.filter(F.col("no_months") > 1).orderBy(F.desc("no_months"), "transmitter")


@query(
    "detected_fish",
    """SELECT count(DISTINCT transmitter) AS fish, count(*) AS detections, min(date) AS first_date, max(date) AS last_date
       FROM dated_long""",
)
def detected_fish(spark, d):
    return summary.detected_fish(restrict.split_datetime(s.detections_long(spark, d)))


@query(
    "rows_per_tag",
    "SELECT transmitter, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM dated_long GROUP BY transmitter",
)
def rows_per_tag(spark, d):
    return summary.rows_per_tag(restrict.split_datetime(s.detections_long(spark, d)))


LINE_SQL = """
SELECT {by} n, round(slope, 9) AS slope, round(my - slope * mx, 9) AS intercept, round(se, 9) AS se_slope,
       round(sqrt(s2 * (1e0 / n + mx * mx / sxx)), 9) AS se_intercept, round(slope / nullif(se, 0), 6) AS t_slope,
       round((my - slope * mx) / nullif(sqrt(s2 * (1e0 / n + mx * mx / sxx)), 0), 6) AS t_intercept,
       round(1 - rss / nullif(syy, 0), 9) AS r2, round((slope / nullif(se, 0)) ** 2, 6) AS f
FROM (SELECT *, sqrt(s2 / sxx) AS se
      FROM (SELECT *, CASE WHEN n > 2 THEN rss / (n - 2) END AS s2
            FROM (SELECT *, sxy / sxx AS slope, greatest(syy - sxy / sxx * sxy, 0) AS rss
                  FROM (SELECT {by} count(*) AS n, avg(monthnum) AS mx, avg(triplen) AS my,
                               nullif(sum(monthnum * monthnum) - sum(monthnum) * avg(monthnum), 0) AS sxx,
                               sum(triplen * triplen) - sum(triplen) * avg(triplen) AS syy,
                               sum(monthnum * triplen) - sum(monthnum) * avg(triplen) AS sxy
                        FROM trips WHERE monthnum IS NOT NULL {group}))))
"""


@query("linear_fit", LINE_SQL.format(by="", group=""))
def linear_fit(spark, d):
    return rounded(distribution.linear_fit(_trips(spark, d), "triplen", "monthnum"), 9, t_slope=6, t_intercept=6, f=6)


@query(
    "linear_fit_by_tag",
    """SELECT transmitter, count(*) AS n,
              CASE WHEN min(monthnum) < max(monthnum) THEN round(regr_slope(triplen, monthnum), 6) END AS slope,
              CASE WHEN min(monthnum) < max(monthnum) THEN round(regr_intercept(triplen, monthnum), 6) END AS intercept
       FROM trips WHERE monthnum IS NOT NULL GROUP BY transmitter""",
)
def linear_fit_by_tag(spark, d):
    fit = distribution.linear_fit(_trips(spark, d), "triplen", "monthnum", ["transmitter"])
    return rounded(fit.select("transmitter", "n", "slope", "intercept"), 6)
