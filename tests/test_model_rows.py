"""Learning queries train on the maps' features and on what readings have over free space."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from airlume.operators import experts
from airlume.plans import geometry_queries as geometry
from airlume.plans import learning_queries as learning
from airlume.plans import parts
from airlume.plans.registry import with_parts
from oracle import connect

SF = "/root/testdata/sf0.001"


def test_target_and_input_are_those_of_the_maps(spark):
    sql = with_parts(f"select sample_id, rssi - {parts.loss(2)} from {{links}}")
    target = dict(connect(SF).execute(sql).fetchall())
    rows = {r["sample_id"]: r for r in learning.model_rows(spark, SF).collect()}
    assert rows.keys() == target.keys()
    assert all(abs(rows[k]["target_db"] - v) < 1e-6 for k, v in target.items())
    want = experts.with_model_input(geometry.features(spark, SF)).select("sample_id", "x").collect()
    assert all(np.array_equal(rows[r["sample_id"]]["x"].toArray(), r["x"].toArray()) for r in want)


def test_experts_train_on_both_twins(spark, monkeypatch):
    seen, train = [], experts.train_experts

    def watched(rows, *args, **kwargs):
        seen.append(rows.groupBy("flipped").agg(F.countDistinct("sample_id").alias("n")).orderBy("flipped").collect())
        return train(rows, *args, **kwargs)

    monkeypatch.setattr(experts, "train_experts", watched)
    out = learning._train_experts(spark, SF)
    n = out.count()
    assert [(r["flipped"], r["n"]) for r in seen[0]] == [(False, n), (True, n)]
