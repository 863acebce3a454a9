"""Rows of one input are folded to two without changing what experts learn."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from airlume.operators import experts, splits

FIT = {"max_iter": 4, "depth": 3}


def test_experts_of_shared_inputs_are_those_of_all_rows(spark):
    rows = spark.range(600).select(
        F.col("id").alias("sample_id"), F.concat(F.lit("i"), F.col("id") * 7 % 12).alias("input_id"),
        (F.col("id") * 37 % 101 + F.col("id") * 7 % 12).cast("double").alias("target_db"),
    )
    inputs = spark.range(12).select(
        F.concat(F.lit("i"), "id").alias("input_id"),
        array_to_vector(F.array((F.col("id") * 5 % 12).cast("double"), (F.col("id") % 4).cast("double"))).alias("x"),
    )
    whole = rows.join(inputs, "input_id").cache()
    members = splits.expert_splits(rows.select("sample_id"), "sample_id", 2, 42).cache()
    folded = experts._with_flags(rows, members, "sample_id", inputs)
    assert folded.count() <= 2 * 12 * 4 and "target_db" in folded.columns
    for e in (0, 1):
        part = experts._of_expert(folded, e).groupBy("is_val").agg(F.sum("_w"), F.sum(F.expr("_w * target_db")), F.sum(F.expr("_w * target_db * target_db")))
        want = whole.join(members.where(F.col("expert_id") == e), "sample_id").groupBy("is_val").agg(
            F.count("*"), F.sum("target_db"), F.sum(F.expr("target_db * target_db"))
        )
        assert np.allclose(sorted(part.collect()), sorted(want.collect()))
    plain = experts.train_experts(whole, members, 2, **FIT)
    shared = experts.train_experts(rows, members, 2, inputs=inputs, **FIT)
    moved = whole.withColumn("target_db", F.col("target_db") + 30)
    tuned = experts.fine_tune_experts(plain, moved, members, **FIT)
    tuned_shared = experts.fine_tune_experts(shared, moved.drop("x"), members, inputs=inputs, **FIT)
    for a, b in ((plain, shared), (tuned, tuned_shared)):
        one = experts.predict_experts(a, whole, F.lit(1.0)).orderBy("sample_id").select("model_0", "model_1").collect()
        two = experts.predict_experts(b, rows, F.lit(1.0), inputs).orderBy("sample_id").select("model_0", "model_1").collect()
        assert np.allclose(one, two, atol=1e-6)
