"""Projected positions and the closed-area zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reefpulse.functions.geo import Vertex, east_component, edges_of, in_edges, in_ring, in_unrolled, unrolled, utm
from reefpulse.operators.joining import LEAST_HOT, hot_groups, repeated, salted

# Cells that a ring takes at most in each direction, and those that the middle one takes by default.
MOST_CELLS, MIDDLE_CELLS = 64, 8


def project_utm(det: DataFrame, lon: str = "long_nad83", lat: str = "lat_nad83", zone: int = 20) -> DataFrame:
    """Adds x_utm20n and y_utm20n in metres."""
    x, y = utm(F.col(lon), F.col(lat), zone)
    return det.withColumns({"x_utm20n": x, "y_utm20n": y})


def _holding_ring(df: DataFrame, ring: Sequence[Vertex] | Column) -> tuple[DataFrame, Sequence[Vertex] | Column]:
    """A ring that is data becomes a column first, because it may be a scalar
    subquery, which array functions do not take."""
    if isinstance(ring, Column):
        return df.withColumn("__ring", ring), F.col("__ring")
    return df, ring


def point_in_polygon(
    df: DataFrame, lon: str, lat: str, ring: Sequence[Vertex] | Column, out: str = "inside"
) -> DataFrame:
    rows, ring = _holding_ring(df, ring)
    return rows.withColumn(out, in_ring(F.col(lon), F.col(lat), ring)).drop("__ring")


def zone_of_bin(bins: DataFrame, ring: Sequence[Vertex] | Column) -> DataFrame:
    """Adds ``mssca``: 'in' or 'out' by the bin's mean position, null without one."""
    rows, ring = _holding_ring(bins, ring)
    lon, lat = F.col("avg_long"), F.col("avg_lat")
    zone = F.when(in_ring(lon, lat, ring), "in").otherwise("out")
    return rows.withColumn("mssca", F.when(lon.isNotNull() & lat.isNotNull(), zone)).drop("__ring")


def _cell(at: Column, level: Column, cell: Column) -> Column:
    return F.floor(at / (cell * F.pow(F.lit(2.0), level)))


def ring_cells(rings: DataFrame, cell: float | None = None, ring_id: str = "ring_id", ring: str = "ring") -> DataFrame:
    """The grid cells of each ring: level, ix, iy, ring_id, ``whole`` and ``edges``, with the grid's ``cell``.

    A cell of level n is ``cell`` * 2 ** n wide; a ring takes the lowest level at which its
    box has at most ``MOST_CELLS`` of them in each direction. A cell that no edge meets
    is inside as a whole, or left out; one that is met holds those edges of the ring that
    reach its row and lie in its column or to the east of it. By default ``cell`` follows from the size of the middle
    ring. A ring is an array<struct<long,lat>>; rings without points are left out, equal rows are one ring,
    and rows that share an id are parts on their own.
    """
    points = F.col("ring")
    xs, ys = F.transform(points, lambda p: p["long"]), F.transform(points, lambda p: p["lat"])
    known = rings.select(F.col(ring_id).alias("ring_id"), F.col(ring).alias("ring")).filter(F.size("ring") > 0).distinct()
    size = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    known = known.withColumns({"size": size, "part": F.xxhash64("ring")})
    width = F.lit(float(cell)) if cell else known.agg(
        F.greatest(F.percentile_approx("size", 0.5) / MIDDLE_CELLS, F.lit(1e-6)).alias("cell")
    ).scalar()
    known = known.withColumn("cell", width)
    level = F.greatest(F.ceil(F.log2(F.col("size") / (F.col("cell") * MOST_CELLS))), F.lit(0).cast("long"))
    level = F.when(F.col("size") > 0, level).otherwise(F.lit(0).cast("long"))
    edges = known.withColumn("level", level).select("ring_id", "part", "cell", "level", F.explode(edges_of(points)).alias("e"))

    def span(e: Column, axis: str) -> tuple[Column, Column]:
        ends = e["a"][axis], e["b"][axis]
        return _cell(F.least(*ends), F.col("level"), F.col("cell")), _cell(F.greatest(*ends), F.col("level"), F.col("cell"))

    low, high = span(F.col("e"), "lat")
    rows = edges.withColumn("iy", F.explode(F.sequence(low, high))).groupBy("ring_id", "part", "cell", "level", "iy").agg(
        F.collect_list("e").alias("row"), F.min(span(F.col("e"), "long")[0]).alias("west"), F.max(span(F.col("e"), "long")[1]).alias("east")
    )
    cells = rows.withColumn("ix", F.explode(F.sequence("west", "east")))
    step = F.col("cell") * F.pow(F.lit(2.0), F.col("level"))
    centre = (F.col("ix") + 0.5) * step, (F.col("iy") + 0.5) * step
    met = F.exists("row", lambda e: (span(e, "long")[0] <= F.col("ix")) & (span(e, "long")[1] >= F.col("ix")))
    cells = cells.withColumns({"met": met, "inside": in_edges(*centre, F.col("row"))}).filter("met OR inside")
    eastern = F.filter("row", lambda e: span(e, "long")[1] >= F.col("ix"))
    return cells.select(
        "cell", "level", "ix", "iy", "ring_id", (~F.col("met")).alias("whole"), F.when(F.col("met"), eastern).alias("edges")
    )


def points_in_rings(
    df: DataFrame, lon: str, lat: str, rings: DataFrame, ring_id: str = "ring_id", ring: str = "ring", cell: float | None = None,
    least: int = LEAST_HOT,
) -> DataFrame:
    """One row for each row of ``df`` and ring that holds its position, with the ring's id.

    Points meet rings on grid cells, by equality; a boundary counts as inside, a row without
    a position is in no ring. Cells with much of the data are dealt over salts that follow from
    counts, so a crowded place is not one task's work, and only rings of such cells are repeated.
    """
    if ring_id in df.columns:
        raise ValueError(f"the points have a column {ring_id} already")
    cells = ring_cells(rings, cell, ring_id, ring)
    grid = cells.agg(F.struct(F.max("cell").alias("cell"), F.collect_set("level").alias("levels"))).scalar()
    located = df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("__grid", grid)
    probes = located.withColumn("__level", F.explode("__grid.levels"))
    at = {f"__{k}": _cell(F.col(c).cast("double"), F.col("__level"), F.col("__grid.cell")) for k, c in (("ix", lon), ("iy", lat))}
    probes = probes.withColumns(at).drop("__grid")
    keys = ["__level", "__ix", "__iy"]
    hot = hot_groups(probes, keys, least)
    plain = [f.name for f in df.schema if "map" not in f.dataType.simpleString()]
    left = salted(probes, hot, keys, plain)
    corners = unrolled(F.col("edges"))
    named = cells.select(
        *[F.col(k[2:]).alias(k) for k in keys], F.col("ring_id").alias("__id"), F.col("whole").alias("__whole"), F.col("edges").alias("__edges"),
        *[c.alias(k) for k, c in corners.items()],
    )
    right = repeated(named, hot, keys)
    held = F.col("__whole") | in_unrolled(F.col(lon).cast("double"), F.col(lat).cast("double"), F.col("__edges"))
    return left.join(right, [*keys, "__salt"]).filter(held).select(*df.columns, F.col("__id").alias(ring_id))


def current_component(df: DataFrame, direction: str = "direction_1_9") -> DataFrame:
    return df.withColumn(f"{direction}_s", east_component(F.col(direction)))
