"""Column expressions for coordinates, path geometry and rings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii in metres and half viewing angles in degrees.
EARTH_RADIUS = 6371000.0
HAVERSINE_RADIUS_KM = 6371.0088
MERCATOR_RADIUS = 6378137.0
HALF_ANGLE_H = math.radians(30)
HALF_ANGLE_V = math.radians(15)

# The path grid has 31 lines across and 30 + 2 * 3 steps along.
GRID_N = 31
GRID_M = 30
GRID_EXTRA = 3
GRID_COLS = GRID_M + 2 * GRID_EXTRA
GRID_CELLS = GRID_N * GRID_COLS


def ll_to_meter(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Local metres (x east, y north) around (lon0, lat0)."""
    x = EARTH_RADIUS * (F.radians(lon) - F.radians(lon0)) * F.cos(F.radians(lat0))
    y = EARTH_RADIUS * (F.radians(lat) - F.radians(lat0))
    return x, y


def meter_to_ll(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Degrees for local metres around (lon0, lat0)."""
    lon = F.degrees(F.radians(lon0) + x / (EARTH_RADIUS * F.cos(F.radians(lat0))))
    lat = F.degrees(F.radians(lat0) + y / EARTH_RADIUS)
    return lon, lat


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_lon), 2
    )
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * HAVERSINE_RADIUS_KM * 1000


def link_distance(x: Column, y: Column, rise: Column) -> Column:
    """Straight-line distance between the antennas."""
    return F.sqrt(x * x + y * y + rise * rise)


def fresnel_radii(distance: Column) -> tuple[Column, Column]:
    """Horizontal and vertical half widths seen at mid-path."""
    return (
        0.5 * distance * math.tan(HALF_ANGLE_H),
        0.5 * distance * math.tan(HALF_ANGLE_V),
    )


def rotation_angles(x: Column, y: Column, rise: Column) -> dict[str, Column]:
    """Cosines and sines of azimuth (theta) and elevation (phi) of a link.

    NULL when the receiver stands on the transmitter.
    """
    r1 = F.sqrt(x * x + y * y)
    r2 = F.sqrt(x * x + y * y + rise * rise)
    ground = F.when(r1 > 0, r1)
    return {
        "cos_theta": x / ground,
        "sin_theta": y / ground,
        "cos_phi": ground / r2,
        "sin_phi": F.when(r1 > 0, rise / r2),
    }


def rotation_matrix(ct: Column, st: Column, cp: Column, sp: Column) -> dict[str, Column]:
    """The nine elements that turn local metres into the link frame."""
    return {
        "h11": cp * ct, "h12": cp * st, "h13": sp,
        "h21": -st, "h22": ct, "h23": F.when(ct.isNotNull(), F.lit(0.0)),
        "h31": -sp * ct, "h32": -sp * st, "h33": cp,
    }


def path_grid_xy(cell: Column, distance: Column, fresnel_h: Column) -> tuple[Column, Column]:
    """Along-path and across-path metres of grid cell ``cell`` (row-major).

    The extension columns before the transmitter and behind the receiver carry
    on at the same spacing, so one formula covers all columns.
    """
    row = F.floor(cell / GRID_COLS)
    col = cell % GRID_COLS
    px = (2 * (col - GRID_EXTRA) - 1) / (2.0 * GRID_M) * distance
    py = (1.0 + 1.0 / GRID_N - (2.0 * row) / GRID_N) * fresnel_h
    return px, py


def grid_to_metres(
    px: Column, py: Column, ct: Column, st: Column, cp: Column
) -> tuple[Column, Column]:
    """Rotate grid metres back to local east/north metres."""
    return cp * ct * px - st * py, cp * st * px + ct * py


def footprint_rect(lon: Column, lat: Column, distance: Column) -> dict[str, Column]:
    """Degrees box around a cell: one path step long, tan(30 deg) as wide."""
    length = distance / (GRID_M - 1)
    width = length * math.tan(HALF_ANGLE_H)
    mx = MERCATOR_RADIUS * F.radians(lon)
    my = MERCATOR_RADIUS * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))

    def to_lat(m: Column) -> Column:
        return F.degrees(2 * F.atan(F.exp(m / MERCATOR_RADIUS)) - math.pi / 2)

    return {
        "rx1": F.degrees((mx - length / 2) / MERCATOR_RADIUS),
        "ry1": to_lat(my - width / 2),
        "rx2": F.degrees((mx + length / 2) / MERCATOR_RADIUS),
        "ry2": to_lat(my + width / 2),
    }


def ring_edges(xs: Column, ys: Column, hole: bool = False) -> Column:
    """Edges (x1, y1, x2, y2) of a ring, counter-clockwise, or clockwise for a hole.

    An open ring is closed, edges without length are left out.
    """
    points = F.arrays_zip(xs.alias("x"), ys.alias("y"))
    ends = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))

    def edge(a: Column, b: Column) -> Column:
        return F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))

    long = F.filter(F.zip_with(points, ends, edge), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    doubled = F.aggregate(
        long, F.lit(0.0), lambda acc, e: acc + (e["x1"] - xs[0]) * (e["y2"] - ys[0]) - (e["x2"] - xs[0]) * (e["y1"] - ys[0])
    )
    back = F.reverse(F.transform(long, lambda e: F.struct(
        e["x2"].alias("x1"), e["y2"].alias("y1"), e["x1"].alias("x2"), e["y1"].alias("y2")
    )))
    return F.when(doubled > 0 if hole else doubled < 0, back).otherwise(long)


def parts_edges(parts: Column) -> Column:
    """Edges of a polygon of several parts: arrays of rings (xs, ys), of which the first is the shell, the rest are holes."""

    def part(rings: Column) -> Column:
        shell = ring_edges(rings[0]["xs"], rings[0]["ys"])
        holes = F.transform(
            F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda ring: ring_edges(ring["xs"], ring["ys"], True)
        )
        return F.concat(shell, F.flatten(holes))

    return F.flatten(F.transform(F.filter(parts, lambda rings: F.size(rings) > 0), part))


def _straddles(a: Column, b: Column, line: Column) -> Column:
    return (a > line) != (b > line)


def crosses_left(e: Column, x: Column, y: Column) -> Column:
    """True when an edge crosses the height ``y`` left of ``x``."""
    return _straddles(e["y1"], e["y2"], y) & (x > edge_x(e, y))


def edge_x(e: Column, y: Column) -> Column:
    """Where an edge that is not level reaches the height ``y``."""
    return e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])


def edge_y(e: Column, x: Column) -> Column:
    """Where an edge that is not upright reaches ``x``."""
    return e["y1"] + (x - e["x1"]) * (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])


def edge_touches(e: Column, x: Column, y: Column) -> Column:
    """True when the point lies on the edge."""
    return (
        ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def _number(edges: Column, test: Callable[[Column], Column]) -> Column:
    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + F.when(test(e), 1).otherwise(0))


def edges_contain(edges: Column, x: Column, y: Column) -> Column:
    """True when the point is strictly inside the outline that all of its edges are given of."""
    return (_number(edges, lambda e: crosses_left(e, x, y)) % 2 == 1) & ~F.exists(edges, lambda e: edge_touches(e, x, y))


def edges_contain_from(edges: Column, x: Column, y: Column, cx: Column, cy: Column, inside: Column) -> Column:
    """The same from the edges near the point alone, given whether the corner (cx, cy) left below it is ``inside``.

    The way leads up from the corner to the height of the point, then to the right.
    """
    up = _number(edges, lambda e: _straddles(e["x1"], e["x2"], cx) & (edge_y(e, cx) > cy) & (edge_y(e, cx) <= y))
    right = _number(edges, lambda e: crosses_left(e, x, y) & (edge_x(e, y) > cx))
    odd = (inside.cast("int") + up + right) % 2 == 1
    return odd & ~F.exists(edges, lambda e: edge_touches(e, x, y))


def edges_meet_rect(edges: Column, rx1: Column, ry1: Column, rx2: Column, ry2: Column) -> Column:
    """True when some edge has a point in the closed rectangle."""

    def hits(e: Column) -> Column:
        apart = (
            (F.greatest(e["x1"], e["x2"]) < rx1)
            | (F.least(e["x1"], e["x2"]) > rx2)
            | (F.greatest(e["y1"], e["y2"]) < ry1)
            | (F.least(e["y1"], e["y2"]) > ry2)
        )
        # The edge misses the rectangle when all four corners lie on one side.
        sides = [
            (e["x2"] - e["x1"]) * (cy - e["y1"]) - (e["y2"] - e["y1"]) * (cx - e["x1"])
            for cx, cy in ((rx1, ry1), (rx1, ry2), (rx2, ry1), (rx2, ry2))
        ]
        return ~apart & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    return F.exists(edges, hits)


def edges_rect_overlap(edges: Column, rx1: Column, ry1: Column, rx2: Column, ry2: Column) -> Column:
    """Exact area shared by a polygon, holes left out, and an axis-aligned rectangle.

    Sums, edge by edge, the area between the rectangle's floor and the edge
    clamped to the rectangle; edges of opposite direction cancel outside.
    """
    top = ry2 - ry1

    def clamp_integral(y: Column) -> Column:
        # Antiderivative of y limited to [0, top].
        return F.when(y <= 0, 0.0).when(y <= top, y * y / 2).otherwise(top * y - top * top / 2)

    def add(acc: Column, e: Column) -> Column:
        x1, y1, x2, y2 = e["x1"], e["y1"] - ry1, e["x2"], e["y2"] - ry1
        slope = (y2 - y1) / (x2 - x1)
        xa = F.least(F.greatest(x1, rx1), rx2)
        xb = F.least(F.greatest(x2, rx1), rx2)
        flat = F.least(F.greatest(y1, F.lit(0.0)), top) * (xb - xa)
        ya, yb = y1 + slope * (xa - x1), y1 + slope * (xb - x1)
        tilted = (clamp_integral(yb) - clamp_integral(ya)) / slope
        return acc + F.when(x1 == x2, 0.0).when(y1 == y2, flat).otherwise(tilted)

    return F.abs(F.aggregate(edges, F.lit(0.0), add))


def ring_rect_overlap(
    xs: Column, ys: Column, rx1: Column, ry1: Column, rx2: Column, ry2: Column
) -> Column:
    """Exact area shared by a simple ring and an axis-aligned rectangle."""
    return edges_rect_overlap(ring_edges(xs, ys), rx1, ry1, rx2, ry2)
