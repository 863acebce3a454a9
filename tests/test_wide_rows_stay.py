"""Feature arrays are not moved or sorted once more to meet the few columns of their sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlume.operators import links
from airlume.plans import geometry_queries
from airlume.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_arrays_meet_the_facts_where_they_lie(spark):
    text = plan(geometry_queries.surface_features(spark, SF))
    assert "ShuffledHashJoin" in text and "Sort [" not in text and text.count("Exchange") == 2


def test_scaled_cells_are_not_joined(spark):
    text = plan(QUERIES["scale_channels"](spark, SF))
    assert text.count("Join") == 1 and "Generate posexplode" in text.split("Join")[0]


def test_cells_keep_columns_of_their_sample(spark):
    rows = spark.range(2).select(F.col("id").alias("sample_id"), F.array(F.lit(1.5), F.lit(2.5)).alias("height"), (F.col("id") * 3).alias("f"))
    got = links.feature_cells(rows, "height", keep=["f"]).orderBy("sample_id", "cell_idx").collect()
    assert [tuple(x) for x in got] == [(0, 0, 1.5, 0), (0, 1, 2.5, 0), (1, 0, 1.5, 3), (1, 1, 2.5, 3)]
