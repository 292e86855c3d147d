"""The whole run from CSV files, checked by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefpulse.plans import stages
from reefpulse.sources import readers
from tests.frames import day, tuples

HEAD = "station,transmitter,detection_time_ast,lat_nad83,long_nad83,sensor\n"
FILES = {
    "det/A69-1.csv": HEAD
    + "1,A69-1,2015-05-01 08:00:00,17.65,-64.87,\n"  # release day, cut
    + "1,A69-1,2015-05-02 23:45:00,17.65,-64.87,\n"
    + "2,A69-1,2015-05-02 23:59:00,17.67,-64.87,\n"
    + "9,A69-1,2015-05-03 00:00:00,17.00,-64.00,\n"  # another array
    + "2,A69-1,2015-05-03 00:40:00,17.60,-64.91,\n",
    "det/A69-2.csv": HEAD + "1,A69-2,2015-05-05 12:00:00,17.65,-64.87,\n",  # not analysed
    "stations.csv": "station,mssca,yearsDeployed,ChessonP\n1,in,2,0.5\n2,out,2,0.5\n",
    "tags.csv": "transmitter,species,release_site,release_year,release_date,TL,Sex,tag_model\n"
    "A69-1,s,r,2015,5/1/15,50,F,V13\nA69-2,s,r,2015,5/1/15,NA,M,V13\n",
    "moons.csv": "month,day,year,timeUTC\nApr,4,2015,12:06:00\nMay,4,2015,03:42:00\n",
    "area.csv": "long,lat\n-64.88333,17.62\n-64.84167,17.62\n-64.84167,17.70\n-64.88333,17.70\n",
}


def test_run(spark, tmp_path):
    (tmp_path / "det").mkdir()
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    names = {"detections": "det", "stations": "stations.csv", "transmitters": "tags.csv", "moons": "moons.csv", "closed_area": "area.csv"}
    paths = stages.run(spark, {k: str(tmp_path / v) for k, v in names.items()}, str(tmp_path / "out"), ["A69-1"])

    read = {k: spark.read.parquet(p) for k, p in paths.items()}
    assert tuples(read["migration"], "station", "transmitter") == [("9", "A69-1")]
    cleaned = read["cleaned"].filter("transmitter = 'A69-1'").orderBy("detection_time_ast").collect()
    assert [r.timediff for r in cleaned] == [143100.0, 840.0, 2460.0, None]
    assert [r.mssca for r in cleaned] == ["in", "in", "out", "out"]
    # the full moon of 4 May, 03:42 UTC, is on 3 May local time
    assert [r.dafm for r in cleaned] == [-2, -1, -1, 0]
    assert read["cut"].count() == 3
    d2, d3 = day("2015-05-02"), day("2015-05-03")
    bins = tuples(read["bins"], "date", "halfhour", "no_stations", "no_detections", "dafm", "avg_lat", "mssca")
    assert bins == [
        (d2, 23.5, 2, 2, -1, 17.66, "in"),
        (d3, 0.0, 0, 0, 0, None, None),
        (d3, 0.5, 1, 1, 0, 17.6, "out"),
    ]
    assert read["bins"].filter(F.col("avg_x").isNull()).count() == 1

    one = readers.read_stage(spark, paths["cut"], read["cut"].schema, ["A69-1"])
    assert one.count() == 3 and "EqualTo(transmitter,A69-1)" in one._jdf.queryExecution().executedPlan().toString()
