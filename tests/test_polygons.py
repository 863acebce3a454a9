"""Polygons with holes, several parts and large areas, against plain tests of points."""

from __future__ import annotations

import numpy as np
import pytest

from airlume.operators import raster, spatial

RING = "array<struct<xs:array<double>,ys:array<double>>>"
SCHEMA = f"poly_id long, site_id long, parts array<{RING}>, measured_height double, type int"


def box(x1, y1, x2, y2, back=False):
    ring = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
    ring = ring[::-1] if back else ring
    return [p[0] for p in ring], [p[1] for p in ring]


def star(cx, cy, radius, seed, n=24):
    draw = np.random.default_rng(seed)
    angle = np.sort(draw.uniform(0, 2 * np.pi, n))
    reach = radius * draw.uniform(0.5, 1, n)
    # open ring: closing it is the operator's work
    return (cx + reach * np.cos(angle)).tolist(), (cy + reach * np.sin(angle)).tolist()


PARTS = {
    # one degree wide, with a courtyard in which the next lies
    1: [[box(0.0, 0.0, 1.0, 1.0), box(0.4, 0.4, 0.6, 0.6)]],
    2: [[star(0.5, 0.5, 0.09, 1)]],
    3: [[star(1.6, 0.5, 0.3, 2), box(1.58, 0.47, 1.63, 0.52, back=True)], [box(2.2, 0.2, 2.5, 0.8, back=True)]],
    4: [[star(0.2, 0.2, 0.15, 3)], [star(2.35, 0.5, 0.1, 4)]],
}
HEIGHT = {1: 10.0, 2: 20.0, 3: 30.0, 4: 40.0}


def inside(x, y, rings):
    odd = False
    for xs, ys in rings:
        for x1, y1, x2, y2 in zip(xs, ys, xs[1:] + xs[:1], ys[1:] + ys[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def holders(x, y):
    return [p for p, parts in PARTS.items() if inside(x, y, [r for part in parts for r in part])]


@pytest.fixture(scope="module")
def layer(spark):
    rows = [(p, 0, [[{"xs": xs, "ys": ys} for xs, ys in part] for part in parts], HEIGHT[p], p) for p, parts in PARTS.items()]
    # a second layer entry with the outline of the first, and one without area
    rows += [(9, 0, rows[0][2], 5.0, 9), (10, 0, [], 99.0, 10), (11, 0, [[{"xs": [0.1], "ys": [0.1]}]], 99.0, 11)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("bucket", [0.01, 0.13])
def test_points_in_holes_and_parts(spark, layer, bucket):
    draw = np.random.default_rng(0)
    points = [(i, 0, float(x), float(y)) for i, (x, y) in enumerate(draw.uniform([-0.1, -0.1], [2.6, 1.1], (3000, 2)))]
    points += [(5000, 0, 0.0, 0.5), (5001, 0, 0.4, 0.5), (5002, 0, 0.5, 0.401), (5003, 7, 0.2, 0.9), (5004, 0, 1.0, 1.0)]
    table = spark.createDataFrame(points, "sample_id long, site_id long, longitude double, latitude double")
    got = {r.sample_id: r.measured_height for r in spatial.point_in_polygon_join(table, layer, "measured_height", 0.0, bucket=bucket).collect()}
    on_outline = {5000, 5001, 5004}  # strictly inside only
    for i, site, x, y in points:
        found = [] if i in on_outline or site else holders(x, y)
        assert got[i] == (HEIGHT[min(found)] if found else 0.0), (x, y)


def test_footprints_and_overlaps_of_holes_and_parts(spark, layer):
    draw = np.random.default_rng(4)
    corners = draw.uniform([-0.05, -0.05], [2.5, 1.0], (400, 2))
    sizes = draw.uniform(0.002, 0.08, (400, 2))
    rows = [(i, 0, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(corners, sizes, strict=True))]
    rows += [(900, 0, 0.45, 0.42, 0.47, 0.44), (901, 0, 0.1, 0.8, 0.9, 0.9), (902, 0, -0.5, -0.5, 3.0, 2.0)]
    boxes = spark.createDataFrame(rows, "box_id long, site_id long, rx1 double, ry1 double, rx2 double, ry2 double")
    high = {r.box_id: r.measured_height for r in spatial.footprint_max_height(boxes, layer, ["box_id"], bucket=0.02).collect()}
    most = {r.box_id: r.type for r in spatial.largest_overlap_join(boxes, layer, "type", "box_id", bucket=0.02).collect()}
    for i, _, x1, y1, x2, y2 in rows:
        grid = [(x, y) for x in np.linspace(x1, x2, 30) for y in np.linspace(y1, y2, 30)]
        share: dict[int, int] = {}
        for x, y in grid:
            for p in holders(x, y):
                share[p] = share.get(p, 0) + 1
        if share:
            assert high[i] is not None and high[i] >= max(HEIGHT[p] for p in share), i
            order = sorted(share.values(), reverse=True)
            if len(order) == 1 or order[0] > 1.25 * order[1] + 30:
                assert most[i] == max(share, key=share.get), i
    # in the courtyard, beside the star; deep inside; around all
    assert (high[900], most[900]) == (None, None) and (high[901], most[901]) == (10.0, 1) and (high[902], most[902]) == (40.0, 1)


def test_no_bucket_holds_an_outline(spark, layer):
    from pyspark.sql import functions as F

    full, partial = spatial.covering_index(layer, "measured_height", F.col("poly_id"), 0.005)
    assert partial.agg(F.max(F.size("edges"))).first()[0] < 24
    # 200 x 200 buckets without the courtyard, mostly 64 at a time
    big = full.where("_rank = 1")
    assert {r.level for r in big.select("level").distinct().collect()} == {0, spatial.WIDE}
    assert big.count() < 25_000


def test_burned_holes_and_parts(spark, layer):
    shown = layer.where("poly_id in (1, 2, 3)").drop("measured_height")
    grid = raster.layer_grid(shown, 0.02)
    meta = grid.first()
    got = {(r.r, r.c): r.type for r in raster.rasterize_polygons(shown, grid).collect()}
    want = {}
    for r in range(meta.nrows):
        for c in range(meta.ncols):
            x, y = meta.x0 + (c + 0.5 + 1e-6) * meta.dx, meta.y0 - (r + 0.5 + 1e-6) * meta.dy
            found = [p for p in holders(x, y) if p < 4]
            if found:
                want[r, c] = max(found)
    assert got == want
