"""Nonlinear experts on Spark ML: training, transfer, prediction, judge, clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlume.functions import features as fx
from airlume.functions.geometry import GRID_COLS, GRID_N
from airlume.operators.evaluation import filter_bad_points
from airlume.operators.forest import Forest, fit_forest
from airlume.operators.skew import salted_join
from airlume.session import materialize

LANDUSE_CODES = 27


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _path_profile(height: pd.Series, slope: pd.Series, landuse: pd.Series) -> pd.Series:
    """Mean and maximum of height and slope per path step, and land-use shares.

    1,116 cells become 171 numbers; one pass over an Arrow batch costs far less
    than as many interpreted array lambdas.
    """
    if not len(height):
        return pd.Series([], dtype=object)
    parts = []
    for channel in (height, slope):
        grid = np.stack(channel.to_numpy()).astype(float).reshape(-1, GRID_N, GRID_COLS)
        parts += [grid.mean(axis=1), grid.max(axis=1)]
    codes = np.stack(landuse.to_numpy())
    shares = [(codes == code).mean(axis=1) for code in range(LANDUSE_CODES)]
    return pd.Series(list(np.hstack([*parts, np.stack(shares, axis=1)])))


def with_model_input(features: DataFrame, form: str = "profile") -> DataFrame:
    """Add the scaled input vector ``x``.

    ``profile``: mean and maximum of height and slope per path step, land-use
    shares, frequency and step. ``flatten``: every cell of every channel.
    A point on the transmitter has no path, so its heights and slopes are NULL; they count as 0.
    """
    known = lambda v: F.coalesce(v, F.lit(0.0))
    height = F.transform("height", lambda v: fx.scale_height(known(v)))
    slope = F.transform("slope", lambda v: fx.scale_slope(known(v)))
    scalars = F.array(fx.scale_thousand(F.col("freq_mhz")), fx.scale_thousand(F.col("step_m")))
    if form == "flatten":
        cells = F.concat(height, slope, F.transform("landuse", lambda t: t.cast("double")))
    else:
        cells = _path_profile(height, slope, "landuse")
    return features.withColumn("x", array_to_vector(F.concat(cells, scalars)))


@dataclass
class Expert:
    """A base model and, after transfer, a model of what it gets wrong."""

    stages: list

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        total = F.lit(0.0)
        for i, model in enumerate(self.stages):
            df = model.setFeaturesCol("x").setPredictionCol(f"_p{i}").transform(df)
            total = total + F.col(f"_p{i}")
        return df.withColumn(name, total).drop(*[f"_p{i}" for i in range(len(self.stages))])


def _booster(
    label: str, max_iter: int, step: float, depth: int, validated: bool, weight: str | None = None
) -> GBTRegressor:
    booster = GBTRegressor(
        featuresCol="x", labelCol=label, maxIter=max_iter, stepSize=step, maxDepth=depth, seed=42,
    )
    if validated:
        booster = booster.setValidationIndicatorCol("is_val")
    return booster.setWeightCol(weight) if weight else booster


# Fits of experts that run at the same time.
FITS_AT_ONCE = 8


def _at_once(rows: DataFrame, fits: Sequence[Callable]) -> list:
    """Results of ``fits``, several at a time: a fit is hundreds of short jobs, which leave a cluster idle one by one."""
    with ThreadPool(FITS_AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(lambda fit: fit()), fits, 1)


def train_experts(
    train: DataFrame, splits: DataFrame, k: int, max_iter: int = 20, step: float = 0.1, depth: int = 4,
    key: str = "sample_id", inputs: DataFrame | None = None,
) -> list[Expert]:
    """One boosted model per expert on its own split, stopped by its validation rows.

    At most 30 experts; every fit is a distributed job, and several run at once. An expert
    whose split is too small for a validation row runs all its steps. With ``inputs``
    (``input_id``, ``x``) the rows name their input instead of holding it.
    """
    rows = _with_flags(train, splits, key, inputs)
    return _at_once(rows, _training(rows, k, max_iter, step, depth, _weight(inputs)))


def _training(
    rows: DataFrame, k: int, max_iter: int = 20, step: float = 0.1, depth: int = 4, weight: str | None = None
) -> list[Callable]:
    """The fit of each expert on flagged ``rows``, to be called."""
    _, validated = _split_kinds(rows)

    def fit(e: int) -> Expert:
        return Expert([_booster("target_db", max_iter, step, depth, e in validated, weight).fit(_of_expert(rows, e))])

    return [partial(fit, e) for e in range(k)]


def _with_flags(rows: DataFrame, splits: DataFrame, key: str, inputs: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``_flags``, expert to is-validation, at most 30 entries each.

    One join serves the fits of all experts. With ``inputs`` rows of one input and one set of
    flags become two of half their number in weight ``_w``, a deviation below and above their
    mean target: number, sum and sum of squares stay, and squared loss asks for nothing else.
    """
    flags = splits.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("expert_id", "is_val"))).alias("_flags"))
    flagged = rows.join(flags, key)
    if inputs is not None:
        sums = flagged.groupBy("input_id", "_flags").agg(
            (F.count("target_db") / 2).alias("_w"), F.avg("target_db").alias("_mean"), F.stddev_pop("target_db").alias("_off")
        )
        sums, ends = sums.where("_w > 0"), F.explode(F.array(F.col("_mean") - F.col("_off"), F.col("_mean") + F.col("_off")))
        flagged = inputs.select("input_id", "x").join(sums.withColumn("target_db", ends).drop("_mean", "_off"), "input_id")
    return materialize(flagged.withColumn("_flags", F.map_from_entries("_flags")), "expert-rows")


def _weight(inputs: DataFrame | None) -> str | None:
    return None if inputs is None else "_w"


def _split_kinds(rows: DataFrame) -> tuple[set[int], set[int]]:
    """Experts that have training rows, and those that have validation rows."""
    kinds = rows.select(F.explode("_flags").alias("e", "is_val")).distinct().collect()
    return {r["e"] for r in kinds if not r["is_val"]}, {r["e"] for r in kinds if r["is_val"]}


def _of_expert(rows: DataFrame, e: int) -> DataFrame:
    """Rows in the split of expert ``e``."""
    marked = rows.withColumn("is_val", F.try_element_at("_flags", F.lit(e)))
    return marked.where(F.col("is_val").isNotNull()).drop("_flags")


def fine_tune_experts(
    experts: Sequence[Expert], new: DataFrame, splits: DataFrame, max_iter: int = 10, step: float = 0.05,
    depth: int = 2, key: str = "sample_id", inputs: DataFrame | None = None,
) -> list[Expert]:
    """Transfer: the base stays frozen, a small model learns its error on the new site.

    Without a new training row an expert stays what it is; without a validation row its
    small model runs all its steps. ``inputs`` as in ``train_experts``.
    """
    rows = _with_flags(new, splits, key, inputs)
    return _at_once(rows, _tuning(rows, experts, max_iter, step, depth, _weight(inputs)))


def _tuning(
    rows: DataFrame, experts: Sequence[Expert], max_iter: int = 10, step: float = 0.05, depth: int = 2,
    weight: str | None = None,
) -> list[Callable]:
    """The tuning of each expert on flagged ``rows``, to be called."""
    trained, validated = _split_kinds(rows)

    def tune(e: int, expert: Expert) -> Expert:
        if e not in trained:
            return expert
        missed = expert.predict(_of_expert(rows, e), "_base").withColumn("_missed", F.col("target_db") - F.col("_base"))
        return Expert([*expert.stages, _booster("_missed", max_iter, step, depth, e in validated, weight).fit(missed)])

    return [partial(tune, e, expert) for e, expert in enumerate(experts)]


def incremental_experts(
    old: DataFrame, new: DataFrame, splits: DataFrame, k: int, new_weight: float = 2.0, max_iter: int = 20,
    step: float = 0.1, depth: int = 4, key: str = "sample_id",
) -> list[Expert]:
    """Refit everything on old and new rows together, new rows weighing more."""
    both = old.withColumn("_w", F.lit(1.0)).unionByName(new.withColumn("_w", F.lit(new_weight)))
    rows = _with_flags(both, splits, key)
    return _at_once(rows, _training(rows, k, max_iter, step, depth, "_w"))


def predict_experts(
    experts: Sequence[Expert], features: DataFrame, offset: Column | None = None, inputs: DataFrame | None = None
) -> DataFrame:
    """``model_i`` per expert: its target estimate, plus ``offset`` when given.

    With ``inputs`` each input is predicted once and met by the rows that name it.
    """
    models = [f"model_{i}" for i in range(len(experts))]
    out = features if inputs is None else inputs.select("input_id", "x")
    for name, expert in zip(models, experts, strict=True):
        out = expert.predict(out, name)
    if inputs is not None:
        out = salted_join(features, materialize(out.drop("x"), "input-predictions"), ["input_id"])
    return out if offset is None else out.withColumns({m: F.col(m) + offset for m in models})


def kfold_oof(
    features: DataFrame, splits: DataFrame, k: int, folds: int = 5, base: Sequence[Expert] | None = None,
    key: str = "sample_id", **options,
) -> DataFrame:
    """Out-of-fold predictions of nonlinear experts; ``features`` has a ``fold``.

    With ``base`` each fold fine-tunes copies of those experts instead of starting anew.
    """
    rows = _with_flags(features, splits, key)
    fits = []
    for f in range(folds):
        kept = rows.where(F.col("fold") != f)
        own = base and [Expert([m.copy() for m in e.stages]) for e in base]
        fits += _training(kept, k, **options) if base is None else _tuning(kept, own, **options)
    fitted = _at_once(rows, fits)
    width = len(fitted) // folds
    return reduce(
        DataFrame.unionByName,
        [
            predict_experts(fitted[f * width : (f + 1) * width], features.where(F.col("fold") == f))
            for f in range(folds)
        ],
    )


def forest_parameters(n: int) -> dict[str, int]:
    """Forest size by number of samples, for the caller to choose by.

    Depth 30 is the deepest Spark allows.
    """
    if n < 200:
        return {"numTrees": 200, "maxDepth": 4, "minInstancesPerNode": 5}
    if n < 1000:
        return {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2}
    return {"numTrees": 100, "maxDepth": 30, "minInstancesPerNode": 1}


# Size of a judge's forest where the caller chooses none.
FOREST = {"numTrees": 100, "maxDepth": 30, "minInstancesPerNode": 1}


def _smallest_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of their unique ``key``; whole rows stay where they are."""
    place = F.struct(F.xxhash64(key).alias("h"), F.col(key).alias("k"))
    total = df.count()
    if total <= n:
        return df
    keys, share = df.select(place.alias("_place")), 2.0 * n / total

    def below(share: float) -> DataFrame:
        return keys if share >= 1 else keys.where(F.col("_place.h") < F.lit(-(2**63) + int(share * 2**64)))

    near = below(share)
    while near.count() < n:
        share *= 2
        near = below(share)
    cut = near.orderBy("_place").limit(n).agg(F.max("_place").alias("m")).first()["m"]
    last = F.struct(F.lit(cut["h"]).alias("h"), F.lit(cut["k"]).alias("k"))
    return df.where(place <= last)


def fit_judge(
    train: DataFrame, truth: str, key: str = "sample_id", parameters: dict[str, int] | None = None,
    max_rows: int | None = None,
) -> Forest:
    """Forest of truth minus median by environment.

    ``train`` has ``x``, the truth, ``median_prediction`` (out-of-fold) and a unique ``key``.
    Every row counts unless a caller asks for at most ``max_rows``, those with the smallest
    hash of the key. ``parameters`` size the forest, ``FOREST`` by default at any number of
    rows; ``forest_parameters`` suggests some.
    """
    rows = train if max_rows is None else _smallest_hashes(train, key, max_rows)
    return fit_forest(rows, F.col(truth) - F.col("median_prediction"), key, 42, **(parameters or FOREST))


def apply_judge(judge: Forest, test: DataFrame) -> DataFrame:
    """``predicted_value_judge``: the median of ``test`` plus what the judge expects it to miss."""
    judged = judge.predict(test, "_shift")
    return judged.withColumn("predicted_value_judge", F.col("predicted_value") + F.col("_shift")).drop("_shift")


def judge_residual_forest(
    train: DataFrame, test: DataFrame, truth: str, key: str = "sample_id",
    parameters: dict[str, int] | None = None,
) -> DataFrame:
    """Fit a judge on ``train`` and apply it to ``test`` (``x`` and ``predicted_value``)."""
    return apply_judge(fit_judge(train, truth, key, parameters), test)


def cluster_bad_points(
    df: DataFrame, k: int, threshold: float, distance: str = "calc_dist", restarts: int = 10, seed: int = 42
) -> DataFrame:
    """K-means of (distance, altitude) over the rows with a large error.

    Of several starts the one with the lowest cost is kept.
    """
    bad = filter_bad_points(df, threshold, k)
    assembled = VectorAssembler(inputCols=[distance, "dn"], outputCol="_raw").transform(bad)
    assembled = materialize(assembled, "bad-points")
    if assembled.isEmpty():
        return assembled.drop("_raw").withColumn("cluster", F.lit(None).cast("int"))
    scaled = (
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True)
        .fit(assembled)
        .transform(assembled)
    )
    fits = [
        KMeans(k=k, seed=seed + i, featuresCol="_scaled", predictionCol="cluster").fit(scaled)
        for i in range(restarts)
    ]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(scaled).drop("_raw", "_scaled")


def cluster_summary(clustered: DataFrame, distance: str = "calc_dist") -> DataFrame:
    return clustered.groupBy("cluster").agg(
        F.max("abs_error").alias("max_error"), F.count(F.lit(1)).alias("n"),
        F.avg(distance).alias("center_distance"), F.avg("dn").alias("center_dn"),
    )


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise; fewer than three distinct points come back as they are."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ordered: list[tuple[float, float]]) -> list[tuple[float, float]]:
        chain: list[tuple[float, float]] = []
        for p in ordered:
            while len(chain) >= 2 and (
                (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])
            ):
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return half(points) + half(points[::-1])


def _partial_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hull per cluster of everything this task sees; only hull points are kept."""
    hulls: dict[int, list[tuple[float, float]]] = {}
    for pdf in batches:
        for cluster, part in pdf.groupby("cluster"):
            new = list(zip(part["px"].tolist(), part["py"].tolist(), strict=True))
            hulls[cluster] = _hull(hulls.get(cluster, []) + new)
    rows = [(c, x, y) for c, hull in hulls.items() for x, y in hull]
    yield pd.DataFrame(rows, columns=["cluster", "px", "py"])


def _final_hull(pdf: pd.DataFrame) -> pd.DataFrame:
    hull = _hull(list(zip(pdf["px"].tolist(), pdf["py"].tolist(), strict=True)))
    return pd.DataFrame(
        [(int(pdf["cluster"].iloc[0]), i, x, y) for i, (x, y) in enumerate(hull)],
        columns=["cluster", "vertex", "px", "py"],
    )


def cluster_hulls(clustered: DataFrame, x: str = "calc_dist", y: str = "dn") -> DataFrame:
    """Hull vertices per cluster in ring order.

    Tasks reduce their own rows to hulls first, twice, so the last step sees a
    few vertices per cluster however many points there are.
    """
    points = clustered.select("cluster", F.col(x).alias("px"), F.col(y).alias("py"))
    schema = "cluster int, px double, py double"
    partial = points.mapInPandas(_partial_hulls, schema)
    merged = partial.repartition(8, "px", "py").mapInPandas(_partial_hulls, schema)
    return merged.groupBy("cluster").applyInPandas(
        _final_hull, "cluster int, vertex int, px double, py double"
    )
