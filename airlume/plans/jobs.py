"""End-to-end jobs: features, area prediction, training, transfer, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlume.functions import radio
from airlume.operators import ensemble, evaluation, experts, linear, links, splits
from airlume.session import materialize
from airlume.sources import files

# Test share of general training and of transfer, seed of the permutation.
GENERAL_TEST_SHARE = 0.15
TRANSFER_TEST_SHARE = 0.01
SEED = 6666

ARRAYS = ("height", "slope", "landuse")


@dataclass
class Maps:
    """Sites and map layers of one job; a missing layer falls back to its default."""

    sites: DataFrame
    buildings: DataFrame | None
    pixels: DataFrame | None
    meta: DataFrame | None
    landuse: DataFrame | None

    def _layers(self) -> tuple:
        return self.sites, self.buildings, self.pixels, self.meta, self.landuse

    def features(self, points: DataFrame) -> DataFrame:
        return links.build_features(points, *self._layers())

    def model_input(self, points: DataFrame, twins: bool = False) -> DataFrame:
        """``features`` with the input vector ``x`` in place of the arrays; with ``twins`` also flipped.

        The arrays of a place become one vector before they meet its points.
        """
        return links.at_points(*self._placed(points, twins))

    def shared_input(self, points: DataFrame, twins: bool = False) -> tuple[DataFrame, DataFrame]:
        """(rows, inputs): ``model_input`` with an ``input_id`` in place of ``x``, and the vector of each.

        For many readings at few places, which all have the vector of their place.
        """
        seen, readings = self._placed(points, twins)
        named = seen.withColumn("input_id", F.concat_ws("-", "place_id", "flipped") if twins else F.col("place_id"))
        return links.at_points(named.drop("x"), readings), named.select("input_id", "x")

    def _placed(self, points: DataFrame, twins: bool) -> tuple[DataFrame, DataFrame]:
        places, readings = links.place_features(points, *self._layers())
        seen = links.augment_flip(places) if twins else places
        return materialize(_with_input(seen), "place-input"), readings


@dataclass
class Trained:
    """Experts of a run with their held-out rows and linear baselines; ``inputs`` where rows name theirs."""

    experts: list
    test: DataFrame
    linear: DataFrame
    inputs: DataFrame | None = None


def _path_loss(df: DataFrame, eta: float = 2):
    return radio.path_loss(F.col("pt_dbm"), F.col("freq_mhz"), F.col("distance_m"), eta)


def _with_input(features: DataFrame) -> DataFrame:
    """Model input in place of the arrays, unless it is there."""
    return features if {"x", "input_id"} & set(features.columns) else experts.with_model_input(features).drop(*ARRAYS)


def row_id() -> Column:
    """Key of a row among the twins."""
    return F.concat_ws("-", F.col("sample_id").cast("string"), F.col("flipped").cast("string"))


def _train_and_test(features: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Augmented training and test rows with model input, keyed by ``row_id``.

    The split is by original sample, so a flipped twin never tests its original.
    ``features`` may hold the twins and their model input already.
    """
    twins = features if "flipped" in features.columns else links.augment_flip(features)
    augmented = splits.split_with_twins(_with_input(twins), share, seed)
    rows = materialize(augmented.withColumn("row_id", row_id()), "training-rows")
    return rows.where("not is_test"), rows.where("is_test")


def _linear_baseline(train: DataFrame, members: DataFrame, test: DataFrame, k: int) -> DataFrame:
    return linear.linear_experts(train, members, test, k, "row_id")


def train(
    features: DataFrame, k: int, share: float = GENERAL_TEST_SHARE, seed: int = SEED, inputs: DataFrame | None = None,
    **fit,
) -> Trained:
    """General training: augment, shuffle, split, linear and boosted experts.

    ``inputs`` where ``features`` are the rows of ``Maps.shared_input``.
    """
    training, test = _train_and_test(features, share, seed)
    members = materialize(splits.expert_splits(training.select("row_id"), "row_id", k, seed), "members")
    fits = experts.train_experts(training, members, k, key="row_id", inputs=inputs, **fit)
    return Trained(fits, test, _linear_baseline(training, members, test, k), inputs)


def transfer(
    base: Sequence, features: DataFrame, share: float = TRANSFER_TEST_SHARE, seed: int = SEED,
    incremental_from: DataFrame | None = None, inputs: DataFrame | None = None, **fit,
) -> Trained:
    """Adapt experts to new sites.

    Small sets are repeated. ``inputs`` as in ``train``, for adapting only. With ``incremental_from`` (the old training
    features) everything is refitted on old and new rows together.
    """
    k = len(base)
    training, test = _train_and_test(features, share, seed)
    members = materialize(splits.expert_splits(training.select("row_id"), "row_id", k, seed), "members")
    repeated = splits.replicate_small(training)
    if incremental_from is None:
        fits = experts.fine_tune_experts(base, repeated, members, key="row_id", inputs=inputs, **fit)
    else:
        old, _ = _train_and_test(incremental_from, 0.0, seed)
        both = members.unionByName(splits.expert_splits(old.select("row_id"), "row_id", k, seed))
        fits = experts.incremental_experts(
            old, repeated.drop("copy"), both.groupBy("row_id", "expert_id").agg(F.min("is_val").alias("is_val")), k, key="row_id", **fit
        )
    return Trained(fits, test, _linear_baseline(training, members, test, k), inputs)


def predict(fits: Sequence, features: DataFrame, judge=None) -> DataFrame:
    """Expert columns, median, spread and path-loss baselines for a feature table.

    With a fitted ``judge`` also ``predicted_value_judge``.
    """
    models = [f"model_{i}" for i in range(len(fits))]
    ready = materialize(_with_input(features), "model-input")
    predicted = experts.predict_experts(fits, ready, _path_loss(ready))
    out = ensemble.with_path_losses(ensemble.ensemble_stats(predicted, models))
    return (out if judge is None else experts.apply_judge(judge, out)).drop("x")


def fit_judge(features: DataFrame, k: int, folds: int = 5, seed: int = SEED, **fit):
    """Judge of what the experts' median misses, from out-of-fold predictions of ``features``."""
    ready = splits.fold_of(_with_input(features), "sample_id", folds, seed)
    ready = materialize(ready, "judge-rows")
    members = materialize(splits.expert_splits(ready.select("sample_id"), "sample_id", k, seed), "members")
    oof = materialize(experts.kfold_oof(ready, members, k, folds, **fit), "judge-oof")
    judged = ensemble.ensemble_stats(oof, [f"model_{i}" for i in range(k)])
    return experts.fit_judge(judged.withColumn("median_prediction", F.col("predicted_value")), "target_db")


def predict_area(
    areas: DataFrame, fits: Sequence, maps: Maps, folder: str, stamp: str, judge=None
) -> DataFrame:
    """Mesh over each area, features, prediction, and the table written as CSV."""
    mesh = files.grid_points(areas).join(areas.select("area_id", "site_id"), "area_id")
    points = mesh.select(
        F.concat_ws("-", "area_id", "point_idx").alias("sample_id"), "site_id",
        F.col("Longitude").alias("longitude"), F.col("Latitude").alias("latitude"),
        F.col("RSSI").cast("double").alias("rssi"),
    )
    return predict_points(points, fits, maps, folder, stamp, judge)


def predict_file(
    spark: SparkSession, source: str, fits: Sequence, maps: Maps, folder: str, stamp: str, judge=None,
    site_id: int | None = None,
) -> DataFrame:
    """Prediction for the distinct points of a user's CSV files below ``source``.

    A point belongs to the site its ``site_id`` column names, else to ``site_id``;
    a point of neither is left out. ``sample_id`` is a digest of the point, the same in
    every run. Files that cannot be read as measurements are passed over.
    """
    rows = files.read_measurements(spark, source, extra=("site_id",))
    owner = F.coalesce(F.expr("try_cast(trim(site_id) as int)"), F.lit(site_id).cast("int"))
    points = rows.withColumn("site_id", owner).where("site_id is not null").distinct()
    digest = F.md5(F.concat_ws(",", "site_id", "longitude", "latitude", "rssi"))
    named = points.select(digest.alias("sample_id"), "site_id", "longitude", "latitude", "rssi")
    return predict_points(materialize(named, "file-points"), fits, maps, folder, stamp, judge)


def predict_points(
    points: DataFrame, fits: Sequence, maps: Maps, folder: str, stamp: str, judge=None
) -> DataFrame:
    """Prediction for given points (sample_id, site_id, longitude, latitude, rssi), written as CSV."""
    predicted = predict(fits, maps.model_input(points), judge)
    path = files.write_prediction(predicted, folder, stamp)
    spark = points.sparkSession
    return spark.read.schema(predicted.schema).option("header", True).csv(path)


def nearfield_fine_tune(benches: DataFrame, base: Sequence, maps: Maps, **fit) -> Trained:
    """Transfer to bench readings taken right at the transmitter."""
    points = files.nearfield_points(benches).select(
        F.concat_ws("-", "bench_id", "reading").alias("sample_id"), "site_id", "longitude", "latitude", "rssi"
    )
    rows, inputs = maps.shared_input(points, twins=True)
    return transfer(base, rows, inputs=inputs, **fit)


def evaluate(long: DataFrame, key: str = "sample_id") -> DataFrame:
    """Error CDF per kind of model: median of its experts, and the best expert of each.

    ``long``: model, key, expert_id, pred, rssi; a few experts per (model, key).
    """
    per_sample = long.groupBy("model", key).agg(
        F.abs(F.median("pred") - F.first("rssi")).alias("median"),
        F.min(F.abs(F.col("pred") - F.col("rssi"))).alias("oracle"),
    )
    errors = per_sample.select(
        key,
        F.inline(
            F.array(
                F.struct(F.col("model"), F.round("median", 9).alias("error")),
                F.struct(F.concat("model", F.lit("_oracle")).alias("model"), F.round("oracle", 9).alias("error")),
            )
        ),
    )
    return evaluation.error_cdf(errors, "error", key, ["model"])
