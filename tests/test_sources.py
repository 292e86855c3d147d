from __future__ import annotations

import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from reefpulse.operators import restrict
from reefpulse.session import shared_folder
from reefpulse.sources import readers, schemas
from reefpulse.sources.writers import write_per_key
from tests.frames import day, detections, ts, tuples


def _file(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(folder)


def test_detections_from_a_folder(spark, tmp_path):
    head = "﻿extra,station,transmitter,detection_time_ast,lat_nad83,long_nad83\n"
    _file(tmp_path, "A69-1601-24991.csv", head + "x,0512,A69-1601-24991,2015-05-01 10:00:01,17.6,-64.9\n")
    path = _file(tmp_path, "A69-1601-24992.csv", head + "x,NA,A69-1601-24992,2015-05-01T10:00:02Z,NA,-64.9\n")
    got = tuples(readers.read_detections(spark, path))
    assert got == [
        ("0512", "A69-1601-24991", ts("2015-05-01 10:00:01"), 17.6, -64.9),
        (None, "A69-1601-24992", ts("2015-05-01 10:00:02"), None, -64.9),
    ]
    named = readers.with_file_tag(readers.read_text_columns(spark, path))
    assert tuples(named, "file_tag") == [("A69-1601-24991",), ("A69-1601-24992",)]


def test_own_time_format(spark, tmp_path):
    path = _file(tmp_path, "a.csv", "station,transmitter,detection_time_ast,lat_nad83,long_nad83\n1,a,2015/05/01 10:00:01,1,2\n")
    formats = {"detection_time_ast": "yyyy/MM/dd HH:mm:ss"}
    assert readers.read_detections(spark, path, formats=formats).first().detection_time_ast == ts("2015-05-01 10:00:01")


def test_files_with_columns_of_their_own(spark, tmp_path):
    _file(tmp_path, "a b.csv", "station,transmitter,detection_time_ast,lat_nad83,long_nad83\n1,a,2015-05-01 10:00:01,1,2\n")
    _file(tmp_path, "b.csv", "transmitter,station,detection_time_ast,lat_nad83,long_nad83\nb,1,2015-05-01 10:00:01,1,2\n")
    path = _file(tmp_path, "c.csv", "long_nad83,lat_nad83,sensor_value,detection_time_ast,transmitter,station\n2,1,7.5,2015-05-01 10:00:01,c,1\n")
    want = [("1", t, ts("2015-05-01 10:00:01"), 1.0, 2.0) for t in "abc"]
    assert tuples(readers.read_detections(spark, path)) == want
    deep = readers.read_detections(spark, path, schemas.DEPTH_DETECTIONS)
    assert tuples(deep, "transmitter", "sensor_value") == [("a", None), ("b", None), ("c", 7.5)]


def _text_scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"FileScan (?:csv|text)", plan))


def test_a_manifest_spares_the_header_scan(spark, tmp_path, monkeypatch):
    det = detections(spark, [(t, str(k), f"2024-01-01 00:0{k}") for k, t in enumerate("abc")])
    path = write_per_key(det, str(tmp_path / "out"), fmt="csv")
    scanned = []
    monkeypatch.setattr(readers, "_found_headers", lambda *a, real=readers._found_headers: scanned.append(1) or real(*a))
    back = readers.read_detections(spark, path)
    assert _text_scans(back) == 1 and not scanned
    assert tuples(back, *sorted(det.columns)) == tuples(det, *sorted(det.columns))
    # A file that the manifest does not know makes readers look for headers themselves.
    _file(tmp_path / "out", "late one.csv", "long_nad83,station,transmitter,detection_time_ast,lat_nad83\n2,9,z,2024-01-02 00:00:00,1\n")
    late = readers.read_detections(spark, path)
    assert scanned and late.count() == 4
    assert tuples(late.filter("transmitter = 'z'"), "station", "long_nad83") == [("9", 2.0)]
    readers.index_headers(spark, path, [f for f, _, _ in schemas.DETECTIONS])
    scanned.clear()
    mixed = readers.read_detections(spark, path)
    assert _text_scans(mixed) == 1 and not scanned and mixed.count() == 4


def test_a_line_like_a_header_is_data(spark, tmp_path):
    head = "station,transmitter,detection_time_ast,lat_nad83,long_nad83"
    _file(tmp_path, "a.csv", f"{head},note\n1,a,2024-01-01 00:00:00,1,2,\"see {head}, above\"\n\n2,a,2024-01-01 00:01:00,1,2,NA\n")
    path = _file(tmp_path, "b.csv", f"note,{head}\nx,3,b,2024-01-01 00:00:00,NA,2\n")
    raw = readers.read_mixed_columns(spark, path, head.split(","))
    assert tuples(raw, "station", "lat_nad83", "note") == [("1", "1", f"see {head}, above"), ("2", "1", None), ("3", None, "x")]


def test_a_folder_of_many_files_is_listed_and_read_by_tasks(spark, tmp_path):
    """The driver keeps some kilobytes for each file that a scan of its own lists; of these it lists none."""
    det = spark.range(30_000).select(
        F.lit("1").alias("station"), F.format_string("t%05d", F.col("id") % 10_050).alias("transmitter"),
        F.timestamp_millis(F.col("id") * 1_000).cast("timestamp_ntz").alias("detection_time_ast"), (F.col("id") / 4).alias("lat_nad83"), F.lit(-64.5).alias("long_nad83"),
    )
    path = write_per_key(det, str(tmp_path / "out"), fmt="csv")
    back = readers.read_detections(spark, path)
    assert not _text_scans(back) and "BinaryFile" not in back._jdf.queryExecution().executedPlan().toString() and not back.inputFiles()
    every = [F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(det.columns)).cast("decimal(38,0)"))]
    assert back.agg(*every).first() == det.agg(*every).first()


_HEAD = "station,transmitter,detection_time_ast,lat_nad83,long_nad83"
_ODD = [
    "1,a,2024-01-01 00:00:00,1,2\r\n\r\n2,a,2024-01-01 00:00:01,NA,2\r\n",
    '"a, ""b""",a,2024-01-01 00:00:00,,""\n  \n\t\nshort,row\n1,long,2024-01-01 00:00:00,1,2,3,4\n\n"open,a,2024-01-01 00:00:00,1,2\n',
    "old,mac,2024-01-01 00:00:00,1,2\rold,mac,2024-01-01 00:00:01,1,2\r",
    "no,end,2024-01-01 00:00:00,1,2",
    "\u00fc\u4e2d\u2028x\x0by,a,bad,1e3,nan\n",
    "",
    "".join(f"{k},many,2024-01-01 00:00:00,{k},{'9' * (k % 40)}\n" for k in range(500)),
]
_NAMES = ["a b.csv", "100%.csv", "x+y,z;[q]{r}.csv", "\u00fc\u00a0\u4e2d#?.csv", "sub=1/deep er/it's.csv", "_k=v/\"q\".csv", "many.txt"]


def _odd_folder(root, heads):
    for name, head, text in zip(_NAMES, heads, _ODD):
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        mark = b"\xef\xbb\xbf" if name.startswith("a") else b""
        at.write_bytes(mark + f"{head}{chr(13) if 'mac' in text else chr(10)}{text}".encode())
    (root / "latin.csv").write_bytes(f"{heads[0]}\n".encode() + b"S\xe9,a,2024-01-01 00:00:00,1,2\n")
    for hidden in ("_headers.csv", ".x.csv", "_tmp/x.csv", "late.csv._COPYING_", "empty.csv"):
        (root / hidden).parent.mkdir(exist_ok=True)
        (root / hidden).write_text("" if hidden == "empty.csv" else "not, to be read")
    return str(root)


def test_tasks_list_files_as_spark_does(spark, tmp_path, monkeypatch):
    path = _odd_folder(tmp_path, [_HEAD] * len(_ODD))
    mine = tuples(readers._files(spark, path + "/../" + tmp_path.name + "/"))
    monkeypatch.setattr(readers, "mounted", lambda *_: None)
    assert mine == tuples(readers._files(spark, path)) and len(mine) == 8


@pytest.mark.parametrize("manifest", [True, False])
@pytest.mark.parametrize("mixed", [True, False])
def test_many_files_read_as_few_do(spark, mixed, manifest, tmp_path, monkeypatch):
    """Quotes, blanks, line ends, marks, bytes that are no text, names and pieces: both ways give the same rows."""
    other = "note,transmitter,station,long_nad83,lat_nad83,detection_time_ast"
    heads = [(other if k % 2 else f"{_HEAD},x y,") if mixed else f"{_HEAD},note,NA,,x y,X Y" for k in range(len(_ODD))]
    path, names = _odd_folder(tmp_path, heads), _HEAD.split(",")
    few = readers.read_mixed_columns(spark, path, names)
    assert _text_scans(few) and few.count() > 500
    monkeypatch.setattr(readers, "MOST_LISTED", 7)
    monkeypatch.setattr(readers, "PIECE", 100)
    if manifest:
        readers.index_headers(spark, path, names)
        monkeypatch.setattr(readers, "_found_headers", None)
    many = readers.read_mixed_columns(spark, path, names)
    assert not _text_scans(many) and "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
    wanted = few.columns if mixed else [*names, "note"]
    assert many.columns == few.columns and tuples(many, *wanted) == tuples(few, *wanted)
    assert repr(tuples(readers.read_detections(spark, path))) == repr(tuples(readers.typed(few, schemas.DETECTIONS)))


def test_a_manifest_is_compared_without_a_broadcast(spark, tmp_path, monkeypatch):
    """It is packed well, so that its rows are many times what its size on disk promises."""
    det = detections(spark, [(t, "1", "2024-01-01 00:00") for t in "abc"])
    path, plans = write_per_key(det, str(tmp_path / "out"), fmt="csv"), []
    frame = type(det)
    empty = frame.isEmpty
    monkeypatch.setattr(frame, "isEmpty", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or empty(df))
    assert readers.read_detections(spark, path).count() == 3
    assert len(plans) == 1 and "Join" not in plans[0]


def test_many_files_of_which_one_differs_are_not_read_shifted(spark, tmp_path, monkeypatch):
    for k in range(3):
        _file(tmp_path, f"{k}.csv", f"{_HEAD}\n1,a,2024-01-01 00:00:00,1,2\n")
    path = _file(tmp_path, "other.csv", "transmitter,station\na,1\n")
    monkeypatch.setattr(readers, "MOST_LISTED", 2)
    with pytest.raises(Exception, match="another header"):
        readers.read_detections(spark, path).collect()


def test_packed_files_are_left_to_spark(spark, tmp_path, monkeypatch):
    import gzip

    for k in range(3):
        (tmp_path / f"{k}.csv.gz").write_bytes(gzip.compress(f"{_HEAD}\n{k},a,2024-01-01 00:00:00,1,2\n".encode()))
    monkeypatch.setattr(readers, "MOST_LISTED", 2)
    back = readers.read_detections(spark, str(tmp_path))
    assert _text_scans(back) == 1 and tuples(back, "station") == [("0",), ("1",), ("2",)]


def test_own_formats_know_no_time_zone(spark, tmp_path):
    """02:30 does not exist in New York on that day; a wall clock keeps it all the same."""
    path = _file(tmp_path, "a.csv", "station,transmitter,detection_time_ast,lat_nad83,long_nad83\n1,a,2024/03/10 02:30:00,1,2\n1,b,bad,1,2\n")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = tuples(readers.read_detections(spark, path, formats={"detection_time_ast": "yyyy/MM/dd HH:mm:ss"}), "detection_time_ast")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert set(got) == {(ts("2024-03-10 02:30:00"),), (None,)}


def test_typed_dimension(spark, tmp_path):
    text = "transmitter,species,release_site,release_year,release_date,TL,Sex,tag_model\na,s,r,2015,3/9/15,49.5,F,V13\nb,s,r,2015,bad,unk,NA,V13P\n"
    got = tuples(readers.read_dimension(spark, _file(tmp_path, "t.csv", text), schemas.TRANSMITTERS, {"release_date": "M/d/yy"}))
    assert got == [("a", "s", "r", 2015, day("2015-03-09"), 49.5, "F", "V13"), ("b", "s", "r", 2015, None, None, None, "V13P")]


def test_moon_table_moves_to_local_time(spark, tmp_path):
    path = _file(tmp_path, "m.csv", "month,day,year,timeUTC\nJan,16,2014,04:52:00\nFeb,14,2014,23:53:00\nMar,1,2014,03:59:59\n")
    got = tuples(readers.read_moons(spark, path), "date")
    assert [d for (d,) in got] == [day("2014-01-16"), day("2014-02-14"), day("2014-02-28")]


def test_currents(spark, tmp_path):
    names = ",".join(old for old, _, _ in schemas.currents(20))
    row = "5/4/15 9:30," + ",".join(str(i) for i in range(40))
    r = readers.read_currents(spark, _file(tmp_path, "c.csv", f"{names}\n{row}\n")).first()
    assert (r.ts_local, r.direction_1, r.direction_20, r.speed_20) == (ts("2015-05-04 09:30"), 0.0, 19.0, 39.0)


def test_bins_with_dotted_names(spark, tmp_path):
    text = "transmitter,year,date,halfhour,No.stations,No.detections,DAFM,avg_lat,avg_long,avg_x,avg_y,mssca\na,2015,2015-05-01,0.5,0,0,-1,NA,NA,NA,NA,NA\n"
    r = readers.read_dimension(spark, _file(tmp_path, "b.csv", text), schemas.BINS).first()
    assert (r.no_stations, r.dafm, r.halfhour, r.avg_lat, r.mssca) == (0, -1, 0.5, None, None)


def test_ring_in_file_order(spark, tmp_path):
    path = _file(tmp_path, "r.csv", "long,lat\n0,0\n2,0\n2,2\n0,2\n0,0\n")
    ring = readers.read_ring(spark, path)
    pts = spark.createDataFrame([(1.0, 1.0, True), (3.0, 1.0, False), (2.0, 1.0, True)], "x double, y double, want boolean")
    from reefpulse.functions.geo import in_ring

    for r in pts.withColumn("ring", ring.scalar()).withColumn("got", in_ring(F.col("x"), F.col("y"), F.col("ring"))).collect():
        assert r.got == r.want


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_per_tag_round_trip(spark, fmt, tmp_path):
    det = detections(spark, [("007", "1", "2024-01-01 00:00:00.000001"), ("8", None, "2024-01-01 00:00"), ("8", "2", "2024-01-01 00:01")])
    path = write_per_key(det, str(tmp_path / "out"), fmt=fmt)
    back = readers.read_stage(spark, path, det.schema) if fmt == "parquet" else readers.read_detections(spark, path)
    assert tuples(back, *sorted(det.columns)) == tuples(det, *sorted(det.columns))


def test_export_of_many_tags_and_a_hot_one(spark, tmp_path):
    """20,000 tags are one file each, written by tasks of a few dozen; a tag with half of the rows takes several."""
    det = spark.range(80_000).select(
        F.when(F.col("id") < 40_000, "hot").otherwise(F.format_string("t%05d", F.col("id") % 20_000)).alias("transmitter"), "id"
    )
    path = write_per_key(det, str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").glob("transmitter=*/*.parquet")]
    assert len({p.parent.name for p in files}) == 20_001 and len([p for p in files if "=hot" not in p.parent.name]) == 20_000
    tasks = {}
    for p in files:
        part = p.name.split("-")[1]
        tasks[part] = tasks.get(part, 0) + 1
    assert len(tasks) > 200 and max(tasks.values()) < 200
    assert len([p for p in files if p.parent.name == "transmitter=hot"]) >= 4
    back = readers.read_stage(spark, path, det.select("id", "transmitter").schema)
    assert back.agg(F.count(F.lit(1)), F.sum("id")).first() == (80_000, 80_000 * 79_999 // 2)


def _passes(spark, det):
    """``det`` read through a Python step, and how many rows have passed it so far."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return det.mapInArrow(counted, det.schema), seen


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_an_export_reads_its_input_twice_and_writes_plain_files(spark, fmt, tmp_path):
    """Once to plan files, once to write them; a tag costs a folder and a file, no checksum file with processes of its own."""
    det = detections(spark, [(f"t{k % 50}", str(k), "2024-01-01 00:00") for k in range(200)])
    rows, seen = _passes(spark, det)
    path = write_per_key(rows, str(tmp_path / "out"), fmt=fmt)
    assert seen.value == 400
    inside = [[p.name for p in d.iterdir()] for d in (tmp_path / "out").iterdir() if d.is_dir() and "=" in d.name]
    assert len(inside) == 50 and all(len(names) == 1 and names[0].startswith("part-") for names in inside)
    assert (tmp_path / "out" / "_SUCCESS").exists()
    with pytest.raises(AnalysisException):
        write_per_key(det, path, fmt=fmt)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_exports_are_as_sparks_writer_makes_them(spark, fmt, tmp_path):
    """Folder names, nulls, quotes, blanks, old dates and files of at most so many rows."""
    tags = ["a b", "c/d=e", "100%", "x:y", "[q]'^", "\u00fc", "", None, "tab\t", "many"]
    text = [None, "", "NA?", 'say "x", y', " lead", "\u00fc"]
    det = spark.createDataFrame(
        [(t, text[k % 6], ts("1500-01-01 00:00:00.000001") if k % 2 else None, k / 3 if k % 4 else None, k) for t in tags for k in range(30 if t == "many" else 7)],
        "transmitter string, note string, at timestamp_ntz, x double, k int",
    )
    mine, sparks = str(tmp_path / "mine"), str(tmp_path / "sparks")
    write_per_key(det, mine, fmt=fmt, max_records_per_file=10)
    write_per_key(det, sparks, fmt=fmt, max_records_per_file=10, mode="append")

    def names(root):
        return {d.name: len([p for p in d.iterdir() if p.name.startswith("part-")]) for d in (tmp_path / root).iterdir() if "=" in d.name}

    def rows(path):
        raw = readers.read_text_columns(spark, path) if fmt == "csv" else readers.read_stage(spark, path, det.schema)
        return sorted(map(repr, raw.select("transmitter", "note", "at", "x", "k").collect()))

    assert names("mine") == names("sparks") and names("mine")["by_transmitter=many" if fmt == "csv" else "transmitter=many"] == 3
    assert rows(mine) == rows(sparks) and len(rows(mine)) == det.count()


def test_a_manifest_is_few_files(spark, tmp_path):
    det = spark.range(3_000).select(F.format_string("t%05d", "id").alias("transmitter"), F.lit("1").alias("station"))
    path = write_per_key(det, str(tmp_path / "out"), fmt="csv")
    assert spark.read.parquet(f"{path}/{readers.HEADERS}").count() == 3_000
    assert len(list((tmp_path / "out" / readers.HEADERS).glob("*.parquet"))) < 4


def test_tags_prune_the_scan(spark, tmp_path):
    det = detections(spark, [(t, "1", "2024-01-01 00:00") for t in "abc"])
    path = write_per_key(det, str(tmp_path / "out"))
    one = readers.read_stage(spark, path, det.schema, tags=["b"])
    assert [r.transmitter for r in one.collect()] == ["b"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*transmitter", plan)
    kept = restrict.keep_tags(readers.read_stage(spark, path, det.schema), spark.createDataFrame([("b",)], "transmitter string"))
    assert kept.count() == 1


def _repeated(rows):
    """Each row ``n`` times, numbered."""
    return rows.withColumn("k", F.explode(F.sequence(F.lit(1), "n"))).select("transmitter", "station", "k")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("mode", ["errorifexists", "append"])
def test_an_export_expands_its_rows_after_dealing_them(spark, fmt, mode, tmp_path):
    """The few rows pass twice, to be planned and written; what they expand to is made once. A tag of few rows that
    become many takes several tasks."""
    few = spark.range(300).select(
        F.when(F.col("id") < 40, "hot").otherwise(F.format_string("t%03d", "id")).alias("transmitter"),
        F.col("id").cast("string").alias("station"),
        F.when(F.col("id") < 40, 2_000).otherwise(F.pmod("id", F.lit(5)) + 1).cast("int").alias("n"),
    )
    rows, seen = _passes(spark, few)
    made = []

    def expand(df):
        out, n = _passes(spark, _repeated(df))
        made.append(n)
        return out

    path = write_per_key(rows, str(tmp_path / "out"), fmt=fmt, mode=mode, expand=expand, size=F.col("n"))
    want = _repeated(few)
    assert seen.value == 600 and sum(n.value for n in made) == want.count()
    back = readers.read_text_columns(spark, path) if fmt == "csv" else readers.read_stage(spark, path, want.schema)
    assert tuples(back.select("transmitter", "station", F.col("k").cast("int"))) == tuples(want)
    folder = tmp_path / "out" / f"{'by_' if fmt == 'csv' else ''}transmitter=hot"
    assert len([p for p in folder.iterdir() if p.name.startswith("part-")]) >= 3
    others = [d for d in (tmp_path / "out").iterdir() if "=t" in d.name]
    assert len(others) == 260 and all(len([p for p in d.iterdir() if p.name.startswith("part-")]) == 1 for d in others)


def test_rows_of_a_folder_out_of_order_are_all_written(spark, tmp_path):
    """A value that comes again in a task gets a further file, not that of before."""
    from reefpulse.sources.writers import _files_of

    root = str(tmp_path / "out")
    rows = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(20)], "k int, __folder string").coalesce(1)
    rows.mapInArrow(_files_of(root, "t", "run", "parquet", 100, None), "n long").collect()
    assert sorted(r.k for r in spark.read.parquet(root).collect()) == list(range(20))


def test_an_export_leaves_the_sessions_batches(spark, tmp_path):
    """Batches of plain rows end by number; Spark's check of their bytes after each row is off meanwhile, and back after."""
    from reefpulse.sources.writers import BATCH_ROWS, _batches_by_rows

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    plain = spark.range(1)
    with _batches_by_rows(spark, plain):
        assert [spark.conf.get(n) for n in names] == [str(BATCH_ROWS), str(2**31 - 1)]
    with _batches_by_rows(spark, plain.select(F.array("id"))):
        assert [spark.conf.get(n) for n in names] == before
    write_per_key(plain.select(F.lit("a").alias("transmitter"), "id"), str(tmp_path / "out"))
    assert [spark.conf.get(n) for n in names] == before


@pytest.mark.parametrize("shared", [True, False])
def test_only_kept_folders_are_read(spark, shared, tmp_path, monkeypatch):
    """Odd names, a folder of several files, a column the files lack, and nothing opened of other tags."""
    tags = ["a b", "c/d=e", "100%", "x+y", "007", "\u00fc", "", None, "many"]
    text = "transmitter string, note string, at timestamp_ntz, k int"
    det = spark.createDataFrame([(t, None if k % 3 else str(t), ts("1500-01-01 00:00") if k % 2 else None, k) for t in tags for k in range(30 if t == "many" else 4)], text)
    path = write_per_key(det, str(tmp_path / "out"), max_records_per_file=10)
    if not shared:
        monkeypatch.setattr(readers, "mounted", lambda *_: None)
    folders = readers.stage_folders(spark, path)
    assert {r.transmitter for r in folders.collect()} == {t or None for t in tags}
    if shared:
        bad = tmp_path / "out" / "transmitter=bad"
        bad.mkdir()
        (bad / "part-0.parquet").write_text("no table")
    mine = [t for t in tags if t != "007"] + ["many", "unheard"]
    kept = restrict.keep_tags(folders, spark.createDataFrame([(t,) for t in mine], "transmitter string"))
    schema = spark.createDataFrame([], f"{text}, extra double").schema
    got = readers.read_folders(spark, path, schema, kept)
    assert got.columns == schema.names
    want = det.filter(F.col("transmitter").isin([t for t in mine if t])).withColumn("extra", F.lit(None).cast("double"))
    assert tuples(got) == tuples(want) and len(tuples(got)) == 50


def test_kept_folders_are_read_without_a_shuffle_of_rows(spark, tmp_path):
    det = spark.range(2_000).select(F.format_string("t%04d", F.col("id") % 500).alias("transmitter"), "id")
    path = write_per_key(det, str(tmp_path / "out"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    try:
        kept = restrict.keep_tags(readers.stage_folders(spark, path), det.filter("id < 100"))
        got = readers.read_folders(spark, path, det.schema, kept)
        assert got.count() == 400
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("MapInArrow rows")[0] and "FileScan parquet" not in plan.split("MapInArrow listed")[0].split("MapInArrow files")[0]
    finally:
        for n in names:
            spark.conf.unset(n)


def test_sink_without_rows_for_a_tag_makes_no_folder(spark, tmp_path):
    det = detections(spark, [("a", "1", "2024-01-01 00:00"), ("b", "9", "2024-01-01 00:00")])
    master = spark.createDataFrame([("1",)], "station string")
    write_per_key(restrict.off_stations(det, master), str(tmp_path / "away"))
    assert [p.name for p in (tmp_path / "away").iterdir() if p.is_dir()] == ["transmitter=b"]


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark, "x", "s3://given/").startswith("s3://given/reefpulse-x-")
    root = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark, "x")
    assert folder != shared_folder(spark, "x")
    if root:
        assert folder.startswith(root)
