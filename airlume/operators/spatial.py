"""Joins between points, footprints and polygon layers.

There is no spatial join in Spark, so both sides are cut into square buckets of
``bucket`` degrees and meet in an equi-join on site and bucket. A polygon is a set of
edges, so holes and further parts need nothing of their own. A bucket holds only the
edges that cross it and whether its lower left corner is inside; buckets that lie
wholly inside come from the gaps between crossed ones, 64 in a row as one where they
can. Nothing ever copies a whole outline into a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlume.functions.geometry import (
    edge_x,
    edges_contain_from,
    edges_meet_rect,
    edges_rect_overlap,
    parts_edges,
    ring_edges,
)
from airlume.operators.skew import salted_join
from airlume.session import materialize, shuffle_width

BUCKET = 0.002
FINE_BUCKET = 0.0005
# Buckets start at this share of their width, so that round coordinates of outlines
# do not lie on their borders.
OFFSET = 0.381966011
# Buckets in a row that lie wholly inside are one from 2^WIDE on.
WIDE = 6
_KEYS = ["site_id", "bx", "by"]
_FULL_KEYS = ["site_id", "level", "bx", "by"]


def _bucket(value: Column | str, bucket: float) -> Column:
    return F.floor((F.col(value) if isinstance(value, str) else value) / bucket + OFFSET)


def _start(index: Column, bucket: float) -> Column:
    """Where a bucket starts."""
    return (index - OFFSET) * bucket


def _over_buckets(df: DataFrame, x1: str, y1: str, x2: str, y2: str, bucket: float) -> DataFrame:
    """One row per bucket that the box touches."""
    return df.withColumn("bx", F.explode(F.sequence(_bucket(x1, bucket), _bucket(x2, bucket)))).withColumn(
        "by", F.explode(F.sequence(_bucket(y1, bucket), _bucket(y2, bucket)))
    )


def with_edges(polygons: DataFrame) -> DataFrame:
    """``polygons`` with ``edges`` in place of ``parts`` (arrays of rings, shell first) or of one ring ``xs``, ``ys``.

    A layer of one small file is read by one task, so polygons are dealt over all tasks
    first, and the edges written: a filter on them would move below the dealing otherwise.
    """
    if "edges" in polygons.columns:
        return polygons
    dealt = polygons.repartition(shuffle_width(polygons.sparkSession), "site_id", "poly_id")
    if "parts" in polygons.columns:
        edged = dealt.withColumn("edges", parts_edges(F.col("parts"))).drop("parts")
    else:
        edged = dealt.withColumn("edges", ring_edges(F.col("xs"), F.col("ys"))).drop("xs", "ys")
    return materialize(edged, "edges")


def _outlines(polygons: DataFrame, aggregates: Sequence[Column]) -> DataFrame:
    """Distinct outlines with their smallest poly_id as ``_oid``.

    Copies of one outline are combined by ``aggregates`` first: a layer with
    the same polygon many times over must not multiply the candidate pairs.
    """
    edged = with_edges(polygons).where(F.size("edges") > 0)
    outlines = edged.groupBy("site_id", "edges").agg(F.min("poly_id").alias("_oid"), *aggregates)
    return outlines.repartition(shuffle_width(polygons.sparkSession), "site_id", "_oid")


def _crossed_buckets(outlines: DataFrame, bucket: float) -> DataFrame:
    """Buckets that an outline crosses, with its edges there, the corner's side and the gap to the next in the row.

    The side of a corner is the parity of crossings left of it at its height, summed
    along the row of buckets.
    """
    e = F.col("e")
    hair = bucket * 1e-6  # rounding must not let an edge slip out of its bucket
    rows = outlines.select("site_id", "_oid", "_rank", "_value", F.explode("edges").alias("e")).withColumn(
        "by", F.explode(F.sequence(
            _bucket(F.least(e["y1"], e["y2"]) - hair, bucket), _bucket(F.greatest(e["y1"], e["y2"]) + hair, bucket)
        ))
    )
    low, high = F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])
    floor, top = _start(F.col("by"), bucket), _start(F.col("by") + 1, bucket)

    def reach(y: Column) -> Column:
        within = F.least(F.greatest(y, F.least(e["y1"], e["y2"])), F.greatest(e["y1"], e["y2"]))
        return F.least(F.greatest(edge_x(e, within), low), high)

    level = e["y1"] == e["y2"]
    left = F.when(level, low).otherwise(F.least(reach(floor), reach(top))) - hair
    right = F.when(level, high).otherwise(F.greatest(reach(floor), reach(top))) + hair
    crossing = F.when((e["y1"] > floor) != (e["y2"] > floor), _bucket(edge_x(e, floor), bucket))
    spread = rows.withColumns({"_cross": crossing, "_left": _bucket(left, bucket), "_right": _bucket(right, bucket)}).withColumn(
        "bx", F.explode(F.sequence(F.least("_left", F.coalesce("_cross", "_left")), F.greatest("_right", F.coalesce("_cross", "_right"))))
    )
    held = spread.groupBy("site_id", "_oid", "by", "bx").agg(
        F.collect_list("e").alias("edges"), F.count(F.when(F.col("_cross") == F.col("bx"), 1)).alias("_n"),
        F.first("_rank").alias("_rank"), F.first("_value").alias("_value"),
    )
    row = Window.partitionBy("site_id", "_oid", "by").orderBy("bx")
    passed = F.sum("_n").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return held.select(
        *_KEYS, "_oid", "_rank", "_value", "edges", ((passed - F.col("_n")) % 2 == 1).alias("_corner"),
        F.when(passed % 2 == 1, F.lead("bx").over(row)).alias("_inside_to"),
    )


def _full_pieces(crossed: DataFrame) -> DataFrame:
    """Buckets wholly inside an outline: single ones at level 0, aligned rows of 2^WIDE at level WIDE."""
    first, last = F.col("bx") + 1, F.col("_inside_to") - 1
    wide = 1 << WIDE
    runs = crossed.where(F.col("_inside_to") > F.col("bx") + 1).select(
        "site_id", "by", "_rank", "_value", first.alias("_a"), last.alias("_b"),
        F.shiftright(first + (wide - 1), WIDE).alias("_wa"), (F.shiftright(last + 1, WIDE) - 1).alias("_wb"),
    )

    def pieces(level: int, a: Column, b: Column) -> Column:
        none = F.array().cast("array<struct<level:int,bx:bigint>>")
        return F.when(a <= b, F.transform(F.sequence(a, b), lambda k: F.struct(F.lit(level).alias("level"), k.alias("bx")))).otherwise(none)

    a, b, wa, wb = (F.col(c) for c in ("_a", "_b", "_wa", "_wb"))
    cut = F.when(
        wa <= wb,
        F.concat(pieces(0, a, wa * wide - 1), pieces(WIDE, wa, wb), pieces(0, (wb + 1) * wide, b)),
    ).otherwise(pieces(0, a, b))
    return runs.select("site_id", "by", "_rank", "_value", F.explode(cut).alias("p")).select(
        "site_id", "p.level", "p.bx", "by", "_rank", "_value"
    )


def covering_index(
    polygons: DataFrame, value: str, rank: Column, bucket: float
) -> tuple[DataFrame, DataFrame]:
    """Index for "the lowest-ranked polygon here": (full, partial) bucket tables.

    Where a bucket lies wholly inside polygons no test is needed later, and one
    row per bucket with the best of them is enough. Buckets that an outline crosses
    are kept for the exact test, unless a full polygon of the bucket outranks it
    anyway. Deep stacks of polygons thus shrink to one row before any point meets them.
    """
    ranked = polygons.withColumn("_rank", rank)
    outlines = _outlines(ranked, [F.min("_rank").alias("_rank"), F.min_by(value, "_rank").alias("_value")])
    crossed = materialize(_crossed_buckets(outlines, bucket), "crossed-buckets")
    full = materialize(
        _full_pieces(crossed).groupBy(*_FULL_KEYS).agg(F.min("_rank").alias("_rank"), F.min_by("_value", "_rank").alias("_value")),
        "full-buckets",
    )
    best = crossed.drop("_inside_to")
    for level in _levels(full):
        here = full.where(F.col("level") == level).select("site_id", "by", F.col("bx").alias("_k"), F.col("_rank").alias("_best"))
        best = salted_join(best.withColumn("_k", F.shiftright("bx", level)), here, ["site_id", "by", "_k"], "left")
        best = best.where(F.col("_best").isNull() | (F.col("_rank") < F.col("_best"))).drop("_best", "_k")
    return full, materialize(best, "partial-buckets")


def _levels(full: DataFrame) -> list[int]:
    """Levels that the index has; they are 0 and WIDE at most."""
    return sorted(r["level"] for r in full.select("level").distinct().collect())


def _on_full(placed: DataFrame, full: DataFrame, hot_rows: int | None) -> DataFrame:
    """Rows with bx and by, joined to the full buckets that hold theirs."""
    levels = _levels(full) or [0]
    pieces = F.array(*[F.struct(F.lit(v).alias("level"), F.shiftright("bx", v).alias("bx")) for v in levels])
    others = [c for c in placed.columns if c != "bx"]
    keyed = placed.withColumn("_p", F.explode(pieces)).select(*others, "_p.level", "_p.bx")
    return salted_join(keyed, full, _FULL_KEYS, hot_rows=hot_rows)


def point_in_polygon_join(
    points: DataFrame, polygons: DataFrame, value: str, default: float | int, key: str = "sample_id",
    bucket: float = BUCKET, hot_rows: int | None = None,
) -> DataFrame:
    """Attribute of the first polygon (lowest poly_id) the point is strictly inside."""
    full, partial = covering_index(polygons, value, F.col("poly_id"), bucket)
    placed = points.select(
        "site_id", key, "longitude", "latitude",
        _bucket("longitude", bucket).alias("bx"), _bucket("latitude", bucket).alias("by"),
    )
    x, y = F.col("longitude"), F.col("latitude")
    corner = _start(F.col("bx"), bucket), _start(F.col("by"), bucket)
    tested = (
        salted_join(placed, partial, _KEYS, hot_rows=hot_rows)
        .where(edges_contain_from(F.col("edges"), x, y, *corner, F.col("_corner")))
        .select(key, "_rank", "_value")
    )
    sure = _on_full(placed, full, hot_rows).select(key, "_rank", "_value")
    first = tested.unionByName(sure).groupBy(key).agg(F.min_by("_value", "_rank").alias("_value"))
    return (
        points.join(first, key, "left")
        .withColumn(value, F.coalesce("_value", F.lit(default)))
        .select(*points.columns, value)
    )


_RECT = ("rx1", "ry1", "rx2", "ry2")


def footprint_heights(
    cells: DataFrame, polygons: DataFrame, keys: Sequence[str], value: str = "measured_height",
    bucket: float = FINE_BUCKET, hot_rows: int | None = None,
) -> DataFrame:
    """(keys, value) rows whose maximum is the highest building a footprint touches.

    Only cells with a match appear; several rows per cell are possible and are
    left to the aggregate that follows. A footprint that no edge of an outline meets
    lies wholly in or out of it, which the bucket of its lower left corner tells.
    """
    full, partial = covering_index(polygons, value, -F.col(value), bucket)
    spread = _over_buckets(cells.select("site_id", *keys, *_RECT), *_RECT, bucket)
    rect = [F.col(c) for c in _RECT]
    corner = _start(F.col("bx"), bucket), _start(F.col("by"), bucket)
    own = (_bucket("rx1", bucket) == F.col("bx")) & (_bucket("ry1", bucket) == F.col("by"))
    inside = own & edges_contain_from(F.col("edges"), rect[0], rect[1], *corner, F.col("_corner"))
    tested = (
        salted_join(spread, partial, _KEYS, hot_rows=hot_rows)
        .where(edges_meet_rect(F.col("edges"), *rect) | inside)
        .select(*keys, F.col("_value").alias(value))
    )
    sure = _on_full(spread.select(*_KEYS, *keys), full, hot_rows).select(*keys, F.col("_value").alias(value))
    return tested.unionByName(sure)


def footprint_max_height(
    cells: DataFrame, polygons: DataFrame, keys: Sequence[str], value: str = "measured_height",
    bucket: float = FINE_BUCKET, hot_rows: int | None = None,
) -> DataFrame:
    """Highest building touched by each cell footprint, NULL where there is none."""
    heights = footprint_heights(cells, polygons, keys, value, bucket, hot_rows)
    highest = heights.groupBy(*keys).agg(F.max(value).alias(value))
    return cells.join(highest, list(keys), "left")


# A rectangle in more buckets than this takes the way of other outlines.
RECT_BUCKETS = 1_024
_SIDES = ("_px1", "_py1", "_px2", "_py2")


def _rounded(area: Column) -> Column:
    """Area in 1e-8 square degrees without its last float digits, so that equal areas compare equal.

    The value is that of ``F.round``, which goes through decimal text, at a tenth of its cost.
    """
    steps = area * 1e8 * 1e6
    whole = F.rint(steps)
    safe = (F.abs(steps) < 1e12) & (F.abs(steps - whole) < 0.499)
    return F.when(safe, whole / 1e6).otherwise(F.round(area * 1e8, 6))


def _with_sides(outlines: DataFrame, bucket: float) -> DataFrame:
    """Outlines with the sides of their bounding box and ``_straight``: it is one rectangle of few buckets, nothing else."""
    edges = F.col("edges")
    x = F.concat(F.transform(edges, lambda e: e["x1"]), F.transform(edges, lambda e: e["x2"]))
    y = F.concat(F.transform(edges, lambda e: e["y1"]), F.transform(edges, lambda e: e["y2"]))
    sides = outlines.withColumns(dict(zip(_SIDES, (F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)), strict=True)))
    x1, y1, x2, y2 = (F.col(c) for c in _SIDES)

    def has(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        return F.exists(edges, lambda e: (e["x1"] == ax) & (e["y1"] == ay) & (e["x2"] == bx) & (e["y2"] == by))

    buckets = (_bucket(x2, bucket) - _bucket(x1, bucket) + 1) * (_bucket(y2, bucket) - _bucket(y1, bucket) + 1)
    around = has(x1, y1, x2, y1) & has(x2, y1, x2, y2) & has(x2, y2, x1, y2) & has(x1, y2, x1, y1)
    straight = (F.size(edges) == 4) & (x1 < x2) & (y1 < y2) & around & (buckets <= RECT_BUCKETS)
    return sides.withColumn("_straight", F.coalesce(straight, F.lit(False)))


def _overlaps_of_rects(places: DataFrame, rects: DataFrame, bucket: float, hot_rows: int | None) -> DataFrame:
    """(_box, _oid, _value, _area) of every place and rectangle that meet.

    A pair is looked at once, in the bucket that holds the lower left corner of what they share.
    """
    held = rects.repartition(shuffle_width(rects.sparkSession), "site_id", "_oid").select("site_id", "_oid", "_value", *_SIDES)
    held = materialize(_over_buckets(held, *_SIDES, bucket), "rect-buckets")
    near = salted_join(_over_buckets(places, *_RECT, bucket), held, _KEYS, hot_rows=hot_rows)
    (rx1, ry1, rx2, ry2), (px1, py1, px2, py2) = ([F.col(c) for c in side] for side in (_RECT, _SIDES))
    left, floor = F.greatest(rx1, px1), F.greatest(ry1, py1)
    wide, high = F.least(rx2, px2) - left, F.least(ry2, py2) - floor
    once = (F.col("bx") == _bucket(left, bucket)) & (F.col("by") == _bucket(floor, bucket))
    return near.where((wide >= 0) & (high >= 0) & once).select("_box", "_oid", "_value", _rounded(wide * high).alias("_area"))


def largest_overlap_join(
    boxes: DataFrame, polygons: DataFrame, value: str, key: str, bucket: float = BUCKET,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per box with the attribute of the polygon it shares most area with.

    Equal areas go to the lower poly_id; boxes that meet nothing keep NULL. Holes
    take no part in the area; a box that only touches an outline meets it. Equal boxes
    of a site are looked at once, and rectangles need their sides only.
    """
    ranked = polygons.withColumn("_rank", F.col("poly_id"))
    merged = _outlines(ranked, [F.min("_rank").alias("_rank"), F.min_by(value, "_rank").alias("_value")])
    known = materialize(_with_sides(merged, bucket), "outlines")
    outlines = known.where("not _straight").drop("_straight", *_SIDES)
    place = ["site_id", *_RECT]
    distinct = boxes.groupBy(*place).agg(F.min(key).alias("_box"))
    # Dealt before the rows multiply; all rows of a place stay in its task, which keeps the best.
    places = materialize(distinct, "places").repartition(shuffle_width(boxes.sparkSession), "_box")
    straight = _overlaps_of_rects(places, known.where("_straight"), bucket, hot_rows)
    if outlines.isEmpty():
        pairs = straight
    else:
        pairs = straight.unionByName(_overlaps_of_outlines(places, outlines, bucket, hot_rows))
    best = pairs.groupBy("_box").agg(F.max_by("_value", F.struct("_area", (-F.col("_oid")).alias("f"))).alias(value))
    found = materialize(places.join(best, "_box").select(*place, value), "found")
    return boxes.join(found, place, "left").select(*boxes.columns, value)


def _overlaps_of_outlines(places: DataFrame, outlines: DataFrame, bucket: float, hot_rows: int | None) -> DataFrame:
    """(_box, _oid, _value, _area) of every place and outline of any form that meet."""
    edges = F.col("edges")
    crossed = materialize(_crossed_buckets(outlines, bucket), "crossed-buckets")
    spread = _over_buckets(places, *_RECT, bucket)
    rect = [F.col(c) for c in _RECT]
    corner = _start(F.col("bx"), bucket), _start(F.col("by"), bucket)
    # Boxes that an outline meets, and those that lie in it. Each is told by one bucket.
    own = (_bucket("rx1", bucket) == F.col("bx")) & (_bucket("ry1", bucket) == F.col("by"))
    near = salted_join(spread, crossed, _KEYS, hot_rows=hot_rows)
    meets = near.where(edges_meet_rect(edges, *rect)).select("site_id", "_box", *_RECT, "_oid").distinct()
    shared = _rounded(edges_rect_overlap(edges, *rect))
    met = salted_join(meets, outlines, ["site_id", "_oid"], hot_rows=hot_rows).select("_box", "_oid", "_value", shared.alias("_area"))
    whole = _rounded((rect[2] - rect[0]) * (rect[3] - rect[1]))
    inside = near.where(own & ~edges_meet_rect(edges, *rect) & edges_contain_from(edges, rect[0], rect[1], *corner, F.col("_corner")))
    full = materialize(_full_pieces(crossed.withColumn("_rank", F.col("_oid"))), "full-outlines")
    within = _on_full(spread.where(own), full, hot_rows).withColumn("_oid", F.col("_rank"))
    kept = [df.select("_box", "_oid", "_value", whole.alias("_area")) for df in (inside, within)]
    # A box that starts in a full bucket may meet the outline elsewhere; its exact area is smaller.
    return met.unionByName(kept[0]).unionByName(kept[1]).groupBy("_box", "_oid").agg(
        F.min("_area").alias("_area"), F.first("_value").alias("_value")
    )
