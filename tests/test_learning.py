"""Nonlinear experts, judge and the stored bundle on a small table."""

from __future__ import annotations

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from airlume.operators import ensemble, experts, splits
from airlume.sources import files

FIT = {"max_iter": 2, "depth": 2}
K = 2


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(80).select(
        F.col("id").alias("sample_id"), (F.col("id") % 7).cast("double").alias("a"),
        (F.col("id") % 5).cast("double").alias("b"), F.pmod("id", F.lit(4)).cast("int").alias("fold"),
    )
    df = df.withColumn("target_db", F.col("a") * 3 - F.col("b"))
    return df.withColumn("x", array_to_vector(F.array("a", "b"))).cache()


@pytest.fixture(scope="module")
def members(rows):
    return splits.expert_splits(rows.select("sample_id"), "sample_id", K, 42).cache()


@pytest.fixture(scope="module")
def fits(rows, members):
    return experts.train_experts(rows, members, K, **FIT)


def _predicted(fits, rows):
    out = experts.predict_experts(fits, rows).orderBy("sample_id").collect()
    return [(r.model_0, r.model_1) for r in out]


def test_flags_give_each_expert_its_own_split(rows, members):
    flagged = experts._with_flags(rows, members, "sample_id")
    for e in range(K):
        got = {(r.sample_id, r.is_val) for r in experts._of_expert(flagged, e).collect()}
        want = {(r.sample_id, r.is_val) for r in members.where(F.col("expert_id") == e).collect()}
        assert got == want and len(want) == 80


def test_bundle_comes_back_whole(spark, rows, fits, tmp_path):
    train = rows.withColumn("median_prediction", F.col("target_db") - F.col("a"))
    judge = experts.fit_judge(train, "target_db", parameters={"numTrees": 5, "maxDepth": 3})
    folder = str(tmp_path / "bundle")
    files.write_ensemble(fits, folder, spark, judge=judge, held_out=rows.drop("x").limit(9), n_experts=K)
    stored = files.read_bundle(spark, folder)
    assert _predicted(stored["experts"], rows) == _predicted(fits, rows)
    assert stored["held_out"].count() == 9 and stored["linear"] is None and stored["facts"]["n_experts"] == "2"
    median = ensemble.ensemble_stats(experts.predict_experts(fits, rows), ["model_0", "model_1"])
    shown = lambda j: [r[0] for r in experts.apply_judge(j, median).orderBy("sample_id").select("predicted_value_judge").collect()]
    assert shown(stored["judge"]) == shown(judge)


def test_few_new_rows_still_tune(rows, fits):
    few = rows.where("sample_id < 4").withColumn("target_db", F.lit(50.0))
    members = splits.expert_splits(few.select("sample_id"), "sample_id", K, 42)
    assert members.where("is_val").isEmpty()
    before, after = _predicted(fits, few), _predicted(experts.fine_tune_experts(fits, few, members, **FIT), few)
    assert all(abs(50 - b) < abs(50 - a) for pair in zip(before, after, strict=True) for a, b in zip(*pair, strict=True))
    assert len(experts.train_experts(few, members, K, **FIT)) == K
    weighed = experts.incremental_experts(few, few.withColumn("sample_id", F.col("sample_id") + 100), members, K, **FIT)
    assert len(weighed) == K


def test_no_new_rows_leave_the_base(rows, members, fits):
    none = rows.where("sample_id < 0")
    assert _predicted(experts.fine_tune_experts(fits, none, members, **FIT), rows) == _predicted(fits, rows)


def test_smallest_hashes_are_exact(spark):
    df = spark.range(5000).withColumnRenamed("id", "sample_id")
    for n in (1, 7, 2600, 4999, 5000, 9000):
        want = {r[0] for r in df.orderBy(F.xxhash64("sample_id"), "sample_id").limit(n).collect()}
        assert {r[0] for r in experts._smallest_hashes(df, "sample_id", n).collect()} == want


def test_judge_takes_a_bounded_number_of_rows(rows):
    train = rows.withColumn("median_prediction", F.lit(0.0))
    small = experts.fit_judge(train, "target_db", parameters={"numTrees": 1, "maxDepth": 2, "subsamplingRate": 1.0}, max_rows=1)
    assert small.trees[0].numNodes == 1


def test_folds_may_start_from_a_base(rows, members, fits):
    out = experts.kfold_oof(rows, members, K, 4, base=fits, **FIT).collect()
    assert sorted(r.sample_id for r in out) == list(range(80))
    assert all(r.model_0 is not None for r in out)
