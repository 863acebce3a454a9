"""Twins and rounded numbers cost one pass over the features."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from airlume.operators import links
from airlume.plans.geometry_queries import r


def test_features_are_made_once_for_both_twins(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def height(i):
        made.add(1)
        return [float(i), i + 1.0]

    rows = spark.range(10).select(
        F.col("id").alias("sample_id"), height(F.col("id")).alias("height"),
        F.array(F.lit(0.5), F.lit(-0.25)).alias("slope"), F.array(F.lit(3), F.lit(None).cast("int")).alias("landuse"),
    )
    got = {(x.sample_id, x.flipped): (x.height, x.slope, x.landuse) for x in links.augment_flip(rows).collect()}
    assert made.value == 10 and len(got) == 20
    assert got[4, False] == ([4.0, 5.0], [0.5, -0.25], [3, None])
    assert got[4, True] == ([5.0, 4.0], [0.25, -0.5], [None, 3])


def test_rounding_is_that_of_spark(spark):
    random.seed(7)
    values = [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e300, -1e-300, 123456789.12345, 9.9e15, 4e-5]
    values += [k / 20000 for k in range(-400, 400)] + [k / 2e6 + 1000 for k in range(400)]
    values += [random.uniform(-1, 1) * 10 ** random.randint(-8, 14) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 3, 4, 6, 9):
        got = df.select(r("v", digits).alias("a"), (F.round("v", digits) + F.lit(0.0)).alias("b"))
        assert got.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
