"""The overlap join looks at equal boxes once, and at a box and a rectangle once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from airlume.operators import spatial

LAYER = "poly_id long, site_id long, xs array<double>, ys array<double>, type int"
BOXES = "box_id long, site_id long, rx1 double, ry1 double, rx2 double, ry2 double"


def _ring(x1, y1, x2, y2):
    return [x1, x2, x2, x1, x1], [y1, y1, y2, y2, y1]


RECTS = [(i, i % 2, 0.01 * (i * 7 % 23), 0.01 * (i * 11 % 19), 0.01 * (i * 7 % 23 + 1 + i % 5), 0.01 * (i * 11 % 19 + 1 + i % 4)) for i in range(60)]
HELD = [(k, k % 2, 0.01 * (k * 5 % 25) + 0.003, 0.01 * (k * 3 % 21), 0.01 * (k * 5 % 25) + 0.003 + 0.004 * (k % 6), 0.01 * (k * 3 % 21) + 0.01) for k in range(40)]
TYPES = {i: 100 + i for i, *_ in RECTS}


def _want(box):
    _, site, x1, y1, x2, y2 = box
    shared = [
        (round((min(x2, b2) - max(x1, b1)) * (min(y2, d2) - max(y1, d1)) * 1e8, 6), -i)
        for i, s, b1, d1, b2, d2 in RECTS if s == site and b1 <= x2 and b2 >= x1 and d1 <= y2 and d2 >= y1
    ]
    return TYPES[-max(shared)[1]] if shared else None


@pytest.mark.parametrize("few", [spatial.RECT_BUCKETS, 4])
def test_equal_boxes_and_pairs_are_looked_at_once(spark, monkeypatch, few):
    monkeypatch.setattr(spatial, "RECT_BUCKETS", few, raising=False)
    layer = spark.createDataFrame([(i, s, *_ring(*at), TYPES[i]) for i, s, *at in RECTS], LAYER)
    copies = [(1000 * c + k, *rest) for c in range(3) for k, *rest in HELD]
    copies.append((9999, 0, None, 0.0, 0.1, 0.1))
    boxes = spark.createDataFrame(copies, BOXES)
    seen, plain = [], spatial._overlaps_of_rects

    def counted(places, *args):
        pairs = plain(places, *args)
        seen.append((places.where("rx1 is not null").count(), pairs.count(), pairs.select("_box", "_oid").distinct().count()))
        return pairs

    monkeypatch.setattr(spatial, "_overlaps_of_rects", counted)
    got = {r.box_id: r.type for r in spatial.largest_overlap_join(boxes, layer, "type", "box_id", bucket=0.007).collect()}
    assert got == {b[0]: None if b[2] is None else _want(b) for b in copies}
    places, pairs, distinct = seen[0]
    assert places == len(HELD) and pairs == distinct and (few == 4 or pairs > 20)


def test_other_outlines_are_no_rectangles(spark):
    rings = {
        1: ([0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0]), 2: ([0.0, 1.0, 0.5, 0.0], [0.0, 0.0, 1.0, 1.0]),
        3: ([0.0, 0.5, 1.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0, 1.0]), 4: ([0.0, 1.0, 0.0, 1.0], [0.0, 1.0, 1.0, 0.0]),
    }
    layer = spark.createDataFrame([(i, 0, xs, ys, i) for i, (xs, ys) in rings.items()], LAYER)
    edged = spatial.with_edges(layer).withColumn("_oid", F.col("poly_id"))
    assert {r._oid for r in spatial._with_sides(edged, 0.1).where("_straight").collect()} == {1}
