"""Wide out-of-fold predictions equal the pivoted long ones, and no row is multiplied for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlume.operators import linear, splits
from airlume.plans.learning_queries import K, SEED, linear_rows


def test_wide_equals_pivoted_long(spark):
    rows = linear_rows(spark, "/root/testdata/sf0.001").limit(300)
    folded = splits.fold_of(rows, "sample_id", 5, SEED)
    members = splits.expert_splits(rows, "sample_id", K, SEED).where("expert_id < 4")  # one expert without rows
    models = [f"model_{i}" for i in range(K)]
    wide = linear.kfold_oof_wide(folded, members, K).select("sample_id", *models)
    long = linear.experts_wide(linear.kfold_oof_linear(folded, members, K), K, ["sample_id"])
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "pivotfirst" not in plan.lower()
    a, b = ({r.sample_id: r[1:] for r in df.collect()} for df in (wide, long.select("sample_id", *models)))
    assert len(a) == 300 and a.keys() == b.keys()
    for key, values in a.items():
        assert values[4] is None and b[key][4] is None
        assert all(abs(x - y) < 1e-9 for x, y in zip(values[:4], b[key][:4]))
