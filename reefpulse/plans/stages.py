"""The three processing stages, and a run of all of them from files to files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from reefpulse.functions.geo import Vertex
from reefpulse.operators import binning, geometry, lunar, restrict, visits
from reefpulse.sources import readers, schemas
from reefpulse.sources.writers import write_clustered, write_per_key


def clean(
    det: DataFrame, stations: DataFrame, moons: DataFrame, ties: Sequence[str] = ("station",), gap: bool = True
) -> DataFrame:
    """Detections at listed stations with split date, gap to the next one, DAFM, zone
    and projected position.

    The gap comes first of the additions, while rows are still narrow, and only if asked for.
    """
    kept = restrict.split_datetime(restrict.at_zoned_stations(det, stations))
    return geometry.project_utm(lunar.add_dafm(visits.time_gap(kept, ties=ties) if gap else kept, moons))


def cut(cleaned: DataFrame, tags: DataFrame, allow: Iterable[str] | DataFrame) -> DataFrame:
    """Cleaned detections of the analysed tags from the day after their release."""
    return restrict.trim_tag_day(restrict.keep_tags(cleaned, allow), tags)


def bin_half_hours(cut_det: DataFrame, ring: Sequence[Vertex] | Column, moons: DataFrame) -> DataFrame:
    """Gap-free half-hour bins with mean position and zone."""
    occupied = binning.bin_positions(restrict.add_half_hour(cut_det))
    return binning.fill_gaps(geometry.zone_of_bin(occupied, ring), moons)


def run(
    spark: SparkSession,
    inputs: Mapping[str, str],
    out: str,
    allow: Iterable[str] | DataFrame,
    release_format: str = "M/d/yy",
) -> dict[str, str]:
    """Reads ``detections``, ``stations``, ``transmitters``, ``moons`` and
    ``closed_area`` from the paths in ``inputs`` and writes the off-array
    detections under ``out``, one folder per tag, and each stage as one table in
    ranges of tag and time.

    Every stage is read back from what the one before wrote, so a lost executor
    costs at most one stage. Returns the path of each table.
    """
    det = readers.read_detections(spark, inputs["detections"])
    stations = readers.read_dimension(spark, inputs["stations"], schemas.STATIONS)
    tags = readers.read_dimension(spark, inputs["transmitters"], schemas.TRANSMITTERS, {"release_date": release_format})
    moons = readers.read_moons(spark, inputs["moons"])
    ring = readers.read_ring(spark, inputs["closed_area"]).scalar()

    paths = {"migration": write_per_key(restrict.off_stations(det, stations), f"{out}/migration")}
    steps = {
        "cleaned": lambda _: clean(det, stations, moons),
        "cut": lambda df: cut(df, tags, allow),
        "bins": lambda df: bin_half_hours(df, ring, moons),
    }
    df = det
    for name, step in steps.items():
        result = step(df)
        order = ("date", "halfhour") if name == "bins" else ("detection_time_ast",)
        paths[name] = write_clustered(result, f"{out}/{name}", ("transmitter", *order))
        df = readers.read_stage(spark, paths[name], result.schema)
    return paths
