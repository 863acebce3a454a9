"""A layer of one small file is no single task's work."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlume.operators import spatial
from airlume.session import shuffle_width


def test_polygons_are_dealt_before_their_edges_are_made(spark):
    one = spark.range(40, numPartitions=1).selectExpr(
        "1L site_id", "id poly_id", "array(0d, 1d, 1d, 0d, 0d) xs", "array(0d, 0d, 1d, 1d, 0d) ys"
    )
    edged = spatial.with_edges(one)
    # A filter on the edges must not bring their making back into the one task that reads the layer.
    assert edged.where(F.size("edges") > 0).count() == 40 and 1 < len(edged.inputFiles()) <= shuffle_width(spark)
