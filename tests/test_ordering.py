from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from airlume.operators.ordering import (
    discrete_quantiles,
    distribution,
    quantiles,
    rank_rows,
    shuffle_rank,
)


def values(spark, n=3000):
    """A third of all rows share one value and one group."""
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("int").alias("g"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 37 % 501).cast("double")).alias("v"),
    )


def test_rank_is_row_number_with_ties(spark):
    df = values(spark).repartition(7)
    got = rank_rows(df, ["v", "id"], (), "rn", "n").toPandas().sort_values("rn")
    want = df.toPandas().sort_values(["v", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["rn"].tolist() == list(range(1, 3001))
    assert (got["n"] == 3000).all()


def test_rank_within_groups_and_descending(spark):
    got = rank_rows(values(spark), [F.desc("v"), "id"], ["g"], "rn", "n").toPandas()
    for _, part in got.groupby("g"):
        ordered = part.sort_values(["v", "id"], ascending=[False, True])
        assert ordered["rn"].tolist() == list(range(1, len(part) + 1))
        assert (part["n"] == len(part)).all()


def test_quantiles_match_numpy(spark):
    df = values(spark)
    probs = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.9, "e": 1.0}
    got = quantiles(distribution(df, "v", ["g"]), "v", probs, ["g"]).toPandas().set_index("g")
    for g, part in df.toPandas().groupby("g"):
        want = np.quantile(part["v"], list(probs.values()))
        np.testing.assert_allclose(got.loc[g, list(probs)].astype(float), want, rtol=1e-12)


def test_discrete_quantile_is_first_value_reaching_share(spark):
    df = values(spark)
    got = discrete_quantiles(distribution(df, "v"), "v", {"p50": 0.5, "p80": 0.8}).first()
    v = np.sort(df.toPandas()["v"].to_numpy())
    cdf = np.arange(1, len(v) + 1) / len(v)
    assert got["p50"] == v[np.searchsorted(cdf, 0.5)]
    assert got["p80"] == v[np.searchsorted(cdf, 0.8)]


def test_shuffle_is_a_permutation_and_ignores_layout(spark):
    df = values(spark)
    a = shuffle_rank(df, "id", 1).select("id", "rn").toPandas().sort_values("id")
    b = shuffle_rank(df.repartition(5, "v"), "id", 1).select("id", "rn").toPandas().sort_values("id")
    assert sorted(a["rn"]) == list(range(1, 3001))
    assert a["rn"].tolist() == b["rn"].tolist()
    other = shuffle_rank(df, "id", 2).select("id", "rn").toPandas().sort_values("id")
    assert a["rn"].tolist() != other["rn"].tolist()


def test_distribution_of_one_value(spark):
    one = spark.createDataFrame(pd.DataFrame({"v": [2.0] * 10}))
    row = distribution(one, "v").first()
    assert (row["lo"], row["hi"], row["n"], row["cnt"]) == (0, 9, 10, 10)
