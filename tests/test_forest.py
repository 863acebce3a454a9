"""The judge's forest: all rows count, split tops and branches in tasks, stored and read back."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from airlume.operators import experts, forest


def _rows(spark, n: int):
    df = spark.range(n).select(
        F.col("id").alias("sample_id"), (F.col("id") * 37 % 101).cast("double").alias("a"),
        (F.col("id") * 53 % 7).cast("double").alias("b"), (F.col("id") % 10 == 9).cast("double").alias("c"),
    )
    return df.withColumns({"target": F.col("a") * 2 - F.col("b") + 50 * F.col("c"), "x": array_to_vector(F.array("a", "b", "c"))})


def _shown(judge, rows) -> np.ndarray:
    return np.array([r[0] for r in judge.predict(rows, "p").orderBy("sample_id").select("p").collect()])


def test_judge_is_fitted_on_every_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(experts, "fit_forest", lambda rows, *_, **__: seen.append(rows.count()))
    monkeypatch.setattr(experts, "JUDGE_ROWS", 100, raising=False)
    monkeypatch.setattr(experts, "_smallest_hashes", lambda df, *_: pytest.fail("rows are left out"))
    experts.fit_judge(_rows(spark, 300).withColumn("median_prediction", F.lit(0.0)), "target")
    assert seen == [300]


def test_lone_tree_learns_every_row(spark):
    rows = _rows(spark, 700)
    judge = forest.fit_forest(rows, F.col("target"), "sample_id", 42, 1, 30)
    truth = np.array([r[0] for r in rows.orderBy("sample_id").select("target").collect()])
    got = _shown(judge, rows)
    # 101 values of a in at most 64 parts: nearly every row is told apart.
    assert np.abs(got - truth).mean() < 1.5 and np.abs(got - truth).mean() < 0.05 * np.abs(truth - truth.mean()).mean()
    stump = forest.fit_forest(rows, F.col("target"), "sample_id", 42, 1, 1)
    assert [t.numNodes for t in stump.trees] == [3] and len(set(_shown(stump, rows))) == 2


@pytest.mark.parametrize("local", [forest.LOCAL_ROWS, 60])
def test_split_tops_hold_the_same_kind_of_trees(spark, tmp_path, monkeypatch, local):
    monkeypatch.setattr(forest, "LOCAL_ROWS", local)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 100)
    rows = _rows(spark, 900)
    judge = forest.fit_forest(rows, F.col("target"), "sample_id", 42, 12, 12, 2)
    assert len(judge.trees) == 12 and any(judge.tops) == (local == 60)
    truth = np.array([r[0] for r in rows.orderBy("sample_id").select("target").collect()])
    got = _shown(judge, rows)
    assert len(got) == 900 and got.min() >= truth.min() and got.max() <= truth.max()
    assert np.abs(got - truth).mean() < 0.35 * np.abs(truth - truth.mean()).mean()
    judge.save(str(tmp_path / "judge"))
    assert (_shown(forest.Forest.load(spark, str(tmp_path / "judge")), rows) == got).all()
    again = forest.fit_forest(rows.repartition(5), F.col("target"), "sample_id", 42, 12, 12, 2)
    assert (_shown(again, rows) == got).all()


def test_equal_targets_give_single_leaves(spark, monkeypatch):
    monkeypatch.setattr(forest, "LOCAL_ROWS", 50)
    judge = forest.fit_forest(_rows(spark, 200), F.lit(0.1), "sample_id", 42, 3, 30)
    assert [t.numNodes for t in judge.trees] == [1, 1, 1]
    assert np.allclose(_shown(judge, _rows(spark, 5)), 0.1)


def test_draws_are_poisson_and_differ_by_tree():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000)
    one, two = (forest._weights(keys, t, 42, 1.0) for t in (0, 1))
    assert abs(one.mean() - 1) < 0.03 and abs(one.var() - 1) < 0.06 and abs(np.corrcoef(one, two)[0, 1]) < 0.03
