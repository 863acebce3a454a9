from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from airlume.sources.files import grid_points

SCHEMA = "area_id int, lon_min double, lon_max double, lat_min double, lat_max double, n int, m int"


def _plain(area_id, lon_min, lon_max, lat_min, lat_max, n, m):
    if lon_min == lon_max and lat_min == lat_max:
        n = m = 1
    if not n or not m:
        return []
    dx = (lon_max - lon_min) / (n - 1) if n > 1 else 0.0
    dy = (lat_max - lat_min) / (m - 1) if m > 1 else 0.0
    return [(area_id, i * n + j, lat_min + i * dy, lon_min + j * dx) for i in range(m) for j in range(n)]


@pytest.mark.parametrize("block", [1, 7, 65_536])
def test_equals_the_plain_loops(spark, block):
    areas = [
        (1, 0.1, 0.9, 10.0, 11.3, 5, 7), (2, 3.0, 3.0, 4.0, 4.0, 9, 9), (3, 0.0, 1.0, 0.0, 1.0, 1, 4),
        (4, 0.0, 1.0, 0.0, 1.0, 0, 4), (5, 0.0, 1.0, 0.0, 1.0, None, 4), (6, 0.3, 0.7, 2.0, 2.0, 14, 1),
    ]
    got = grid_points(spark.createDataFrame(areas, SCHEMA), block)
    rows = sorted(tuple(r) for r in got.select("area_id", "point_idx", "Latitude", "Longitude").collect())
    assert rows == sorted(x for a in areas for x in _plain(*a))


def test_empty_table(spark):
    assert grid_points(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_large_area_is_spread_over_all_tasks(spark):
    areas = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0, 5_000, 2_000), (2, 0.0, 1.0, 0.0, 1.0, 2, 2)], SCHEMA)
    sizes = [r["count"] for r in grid_points(areas).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_000_004
    assert len(sizes) >= 8 and max(sizes) < 1.5 * sum(sizes) / len(sizes)
