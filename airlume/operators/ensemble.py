"""Statistics over the experts of an ensemble and corrections of its median."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlume.functions import radio
from airlume.operators.cleaning import bin_edges, with_bins
from airlume.session import place_by

# Bins of the bias table and the agreement it must exceed.
DISTANCE_BINS = 100
ALTITUDE_BINS = 20
SIGN_AGREEMENT = 0.75
UNCERTAINTY_DIGITS = 6


def median_of(values: Column, n: int) -> Column:
    """Median of an array of ``n`` known values."""
    ordered = F.array_sort(values)
    if n % 2:
        return F.get(ordered, F.lit(n // 2))
    return (F.get(ordered, F.lit(n // 2 - 1)) + F.get(ordered, F.lit(n // 2))) / 2


def std_of(values: Column, n: int, ddof: int = 0) -> Column:
    """Standard deviation of an array of ``n`` known values."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return F.sqrt(squares / (n - ddof))


def ensemble_stats(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Median and population spread over the expert columns, row by row.

    The experts of a sample are columns of one row, so nothing is shuffled.
    """
    values = F.array(*[F.col(m) for m in models])
    return df.withColumn("predicted_value", median_of(values, len(models))).withColumn(
        "uncertainty", std_of(values, len(models))
    )


def with_rounded_uncertainty(df: DataFrame) -> DataFrame:
    """Drop float noise so that equal spreads order and cut alike."""
    return df.withColumn("uncertainty", F.round("uncertainty", UNCERTAINTY_DIGITS))


def ensemble_stats_long(long: DataFrame, key: str = "sample_id") -> DataFrame:
    """The same from one row per (sample, expert): at most 30 rows per group."""
    return long.groupBy(key).agg(
        F.median("pred").alias("predicted_value"), F.stddev_pop("pred").alias("uncertainty")
    )


def to_long(df: DataFrame, models: Sequence[str], *keep: str) -> DataFrame:
    """One row per (sample, expert)."""
    experts = F.array(
        *[F.struct(F.lit(i).alias("expert_id"), F.col(m).alias("pred")) for i, m in enumerate(models)]
    )
    return df.select(*keep, F.inline(experts))


def abs_error(df: DataFrame) -> DataFrame:
    """Add ``abs_error``; an error already in the table is taken as it is."""
    if "median_abs_error" in df.columns:
        return df.withColumn("abs_error", F.col("median_abs_error"))
    return df.withColumn("abs_error", F.abs(F.col("predicted_value") - F.col("rssi")))


def best_expert(df: DataFrame, models: Sequence[str], truth: str = "rssi") -> DataFrame:
    """Index and error of the closest expert; the lowest index wins a tie."""
    errors = F.array(*[F.abs(F.col(m) - F.col(truth)) for m in models])
    return df.withColumn("best_model_error", F.array_min(errors)).withColumn(
        "best_model_idx", (F.array_position(errors, F.col("best_model_error")) - 1).cast("int")
    )


def error_summary(df: DataFrame, corrected: str) -> DataFrame:
    """Mean absolute error of the median and of the corrected value."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("predicted_value") - F.col("rssi"))).alias("mae_median"),
        F.avg(F.abs(F.col(corrected) - F.col("rssi"))).alias("mae_corrected"),
    )


_BINS = {"distance_m": DISTANCE_BINS, "dn": ALTITUDE_BINS}


def calibration_table(train: DataFrame, models: Sequence[str], edges: DataFrame | None = None) -> DataFrame:
    """Mean error in spreads and mean direction per altitude and distance bin.

    At most 20 x 100 rows, whatever the number of training rows.
    """
    n = len(models)
    values = F.array(*[F.col(m) for m in models])
    median = median_of(values, n)
    binned = with_bins(train, edges if edges is not None else bin_edges(train, _BINS), _BINS)
    # Round off float noise, so that an exact hit has direction 0.
    off = F.round(median - F.col("rssi"), 9)
    return (
        binned.where(F.col("dn_bin").isNotNull() & F.col("distance_m_bin").isNotNull())
        .groupBy("dn_bin", "distance_m_bin")
        .agg(
            F.avg(F.abs(off) / (std_of(values, n, ddof=1) + 1e-9)).alias("k"),
            F.avg(F.signum(off)).alias("sign"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def calibration_lookup(df: DataFrame, table: DataFrame, edges: DataFrame) -> DataFrame:
    """Bring k and sign of its bin to every row; 0 where the bin is unknown."""
    binned = with_bins(df, edges, _BINS)
    # The table holds one row per bin: at most 20 x 100.
    joined = binned.join(F.broadcast(table.drop("n")), ["dn_bin", "distance_m_bin"], "left")
    return joined.withColumns({"k": F.coalesce("k", F.lit(0.0)), "sign": F.coalesce("sign", F.lit(0.0))})


def judge_bias_correction(
    train: DataFrame, test: DataFrame, models: Sequence[str], agreement: float = SIGN_AGREEMENT
) -> DataFrame:
    """Shift the median where the training errors of its bin agree in direction."""
    edges = bin_edges(train, _BINS)
    table = calibration_table(train, models, edges)
    looked_up = calibration_lookup(ensemble_stats(test, models), table, edges)
    shift = F.col("sign") * F.col("k") * F.col("uncertainty")
    return looked_up.withColumn(
        "corrected",
        F.when(F.abs(F.col("sign")) > agreement, F.col("predicted_value") - shift).otherwise(
            F.col("predicted_value")
        ),
    )


def top_g_groups(probs: DataFrame, g: int, key: str = "sample_id") -> DataFrame:
    """The g most probable groups per sample, probabilities scaled to sum 1."""
    order = Window.partitionBy(key).orderBy(F.desc("p"), F.desc("group_id"))
    top = probs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= g)
    return top.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(key)))


def mixture_of_experts(
    df: DataFrame, models: Sequence[str], probs: DataFrame, groups: DataFrame, g: int = 1,
    key: str = "sample_id", offset: Column | None = None,
) -> DataFrame:
    """Probability-weighted group medians over the g most probable groups.

    ``offset`` (a path loss, say) is added to every mixture. A sample without
    group rows stays, with no mixture; a group
    without experts is refused.

    ``groups`` maps at most 30 experts to groups. The chosen groups of a sample
    are gathered into one short array next to its expert columns.
    """
    members: dict[int, list[str]] = {}
    for row in groups.orderBy("expert_id").collect():
        members.setdefault(row["group_id"], []).append(models[row["expert_id"]])
    if not members:
        raise ValueError("no expert has a group")
    df, probs = place_by(key, df, probs)
    chosen = top_g_groups(probs, g, key).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("group_id", "p"))).alias("_p")
    )
    total = F.lit(0.0)
    for group, names in sorted(members.items()):
        weight = F.coalesce(F.try_element_at("_p", F.lit(group)), F.lit(0.0))
        total = total + weight * median_of(F.array(*[F.col(m) for m in names]), len(names))
    mixed = total if offset is None else total + offset
    return df.join(chosen, key, "left").withColumn("moe", F.when(F.col("_p").isNotNull(), mixed)).drop("_p")


def with_path_losses(df: DataFrame) -> DataFrame:
    """Free-space power for decay exponents 2 and 3."""
    args = (F.col("pt_dbm"), F.col("freq_mhz"), F.col("distance_m"))
    return df.withColumns(
        {"path_loss_eta_2": radio.path_loss(*args, 2), "path_loss_eta_3": radio.path_loss(*args, 3)}
    )


def oof_report(predicted: DataFrame, models: Sequence[str], receivers: DataFrame, key: str = "sample_id") -> DataFrame:
    """Out-of-fold table: experts, median, its error, the best expert, receiver columns."""
    values = F.array(*[F.col(m) for m in models])
    out = predicted.withColumn("median_prediction", median_of(values, len(models))).withColumn(
        "median_abs_error", F.abs(F.col("median_prediction") - F.col("rssi_tv"))
    )
    reported, receivers = place_by(key, best_expert(out, models, "rssi_tv"), receivers)
    return reported.join(receivers, key)
