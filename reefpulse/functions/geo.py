"""Map projection, ring containment and compass arithmetic as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

Vertex = tuple[float, float]

# GRS80 ellipsoid and the UTM grid constants.
GRS80_A = 6378137.0
GRS80_INV_F = 298.257222101
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0


def _kruger(n: float) -> tuple[float, list[float]]:
    """Rectifying radius factor and forward series of the published transverse
    Mercator expansion in the third flattening, to fourth order."""
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    return radius, alpha


def utm(lon: Column, lat: Column, zone: int = 20) -> tuple[Column, Column]:
    """Easting and northing in metres of a northern-hemisphere NAD83 position."""
    f = 1 / GRS80_INV_F
    n = f / (2 - f)
    radius, alpha = _kruger(n)
    ecc = 2 * math.sqrt(n) / (1 + n)
    dlon = F.radians(lon - F.lit(float(6 * zone - 183)))
    sin_lat = F.sin(F.radians(lat))
    conformal = F.sinh(F.atanh(sin_lat) - F.lit(ecc) * F.atanh(F.lit(ecc) * sin_lat))
    xi = F.atan2(conformal, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(F.lit(1.0) + conformal * conformal))
    x, y = eta, xi
    for j, a in enumerate(alpha, start=1):
        x = x + F.lit(a) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
        y = y + F.lit(a) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
    scale = F.lit(UTM_K0 * GRS80_A * radius)
    return F.lit(UTM_FALSE_EASTING) + scale * x, scale * y


def _column_edge(lon: Column, lat: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Whether a ray to the east crosses the edge from a to b, and whether the
    edge holds the point; a and b are vertex structs."""
    x1, y1, x2, y2 = a["long"], a["lat"], b["long"], b["lat"]
    turn = (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)
    crosses = ((y1 > lat) != (y2 > lat)) & (turn != 0) & ((turn > 0) == (y2 > y1))
    holds = (
        (turn == 0)
        & lon.between(F.least(x1, x2), F.greatest(x1, x2))
        & lat.between(F.least(y1, y2), F.greatest(y1, y2))
    )
    return crosses, holds


def _constant_edge(lon: Column, lat: Column, a: Vertex, b: Vertex) -> tuple[Column | None, Column]:
    """The same for two constant vertices, with what is known about the edge worked
    in, so that the generated code stays short."""
    (x1, y1), (x2, y2) = a, b
    in_lat = lat.between(min(y1, y2), max(y1, y2))
    if y1 == y2:
        return None, (lat == y1) & lon.between(min(x1, x2), max(x1, x2))
    reached = (lat >= min(y1, y2)) & (lat < max(y1, y2))
    if x1 == x2:
        return reached & (lon < x1), (lon == x1) & in_lat
    turn = F.lit(x2 - x1) * (lat - y1) - F.lit(y2 - y1) * (lon - x1)
    return reached & (turn > 0 if y2 > y1 else turn < 0), (turn == 0) & in_lat


def edges_of(ring: Column) -> Column:
    """The edges of a ring, an array of structs a and b; the last one closes it."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_edges(lon: Column, lat: Column, edges: Column) -> Column:
    """True inside a closed ring of ``edges`` or on one of them.

    Edges that neither hold the point nor meet a ray from it to the east may be missing.
    """
    odd = F.aggregate(edges, F.lit(False), lambda acc, e: acc != _column_edge(lon, lat, e["a"], e["b"])[0])
    return F.exists(edges, lambda e: _column_edge(lon, lat, e["a"], e["b"])[1]) | odd


# Edges of a row that are tested by generated code; the others are walked one by one.
UNROLLED = 4


def unrolled(edges: Column, prefix: str = "__e") -> dict[str, Column]:
    """The ends of the first ``UNROLLED`` edges as plain numbers, for ``in_unrolled``. A missing edge
    is a point at infinity, which nothing meets."""
    far = F.lit(float("inf"))
    ends = {f"{i}{end}{axis[:2]}": F.get(edges, F.lit(i))[end][axis] for i in range(UNROLLED) for end in "ab" for axis in ("long", "lat")}
    return {f"{prefix}{k}": F.coalesce(c.cast("double"), far) for k, c in ends.items()}


def in_unrolled(lon: Column, lat: Column, edges: Column, prefix: str = "__e") -> Column:
    """As ``in_edges`` beside the columns of ``unrolled``; null edges hold nothing."""
    def end(i: int, e: str) -> dict[str, Column]:
        return {axis: F.col(f"{prefix}{i}{e}{axis[:2]}") for axis in ("long", "lat")}

    tests = [_column_edge(lon, lat, end(i, "a"), end(i, "b")) for i in range(UNROLLED)]
    rest, more = F.slice(edges, UNROLLED + 1, F.size(edges)), F.coalesce(F.size(edges) > UNROLLED, F.lit(False))
    odd_rest = F.aggregate(rest, F.lit(False), lambda acc, e: acc != _column_edge(lon, lat, e["a"], e["b"])[0])
    held_rest = F.exists(rest, lambda e: _column_edge(lon, lat, e["a"], e["b"])[1])
    odd = reduce(lambda p, q: p != q, (c for c, _ in tests))
    held = reduce(lambda p, q: p | q, (h for _, h in tests))
    few = held | odd
    return F.when(more, held | held_rest | (odd != odd_rest)).otherwise(few)


def in_ring(lon: Column, lat: Column, ring: Sequence[Vertex] | Column) -> Column:
    """True inside the ring or on its boundary; null for a null position.

    ``ring`` is a list of (long, lat) vertices, unrolled to plain comparisons in
    generated code, or an array<struct<long,lat>> column for a ring that is data.
    It may repeat the first vertex at the end.
    """
    known = lon.isNotNull() & lat.isNotNull()
    if isinstance(ring, Column):
        return F.when(known, in_edges(lon, lat, edges_of(ring)))
    pts = [(float(x), float(y)) for x, y in ring]
    if pts[0] == pts[-1]:
        pts = pts[:-1]
    edges = [_constant_edge(lon, lat, a, b) for a, b in zip(pts, pts[1:] + pts[:1])]
    odd = reduce(lambda p, q: p != q, (c for c, _ in edges if c is not None))
    held = reduce(lambda p, q: p | q, (h for _, h in edges))
    xs, ys = zip(*pts)
    in_box = lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys))
    return F.when(known, in_box & (odd | held))


def east_component(direction_deg: Column) -> Column:
    """+1 flowing east, -1 flowing west."""
    return F.cos(F.radians(direction_deg - F.lit(90.0)))
