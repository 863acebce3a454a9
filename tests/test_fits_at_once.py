"""Fits of experts run side by side."""

from __future__ import annotations

import threading

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from airlume.operators import experts, splits


def test_experts_are_fitted_at_once(spark, monkeypatch):
    rows = spark.range(40).select(F.col("id").alias("sample_id"), F.col("id").cast("double").alias("target_db"))
    rows = rows.withColumn("x", array_to_vector(F.array("target_db"))).withColumn("fold", (F.col("sample_id") % 2).cast("int"))
    members = splits.expert_splits(rows.select("sample_id"), "sample_id", 3, 42)
    met, booster = threading.Barrier(3), experts._booster

    def waiting(*args):
        met.wait(60)  # raises unless three fits are under way
        return booster(*args)

    monkeypatch.setattr(experts, "_booster", waiting)
    assert len(experts.train_experts(rows, members, 3, max_iter=1, depth=1)) == 3
