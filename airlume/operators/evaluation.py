"""Evaluation reports as chart-ready tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from airlume.operators.ensemble import best_expert, to_long
from airlume.operators.ordering import discrete_quantiles, distribution, quantiles, rank_rows
from airlume.session import materialize

# Uncertainty bins (dB), high-error limit (dB), expert slots.
UNCERTAINTY_BINS = ("0-3 dB", "3-5 dB", "> 5 dB")
QUANTILE_GROUPS = ("low", "mid", "high")
HIGH_ERROR_DB = 10.0
EXPERT_SLOTS = 30


def error_cdf(df: DataFrame, error: str, key: str, group: Sequence[str] = ()) -> DataFrame:
    """Every error with its share of rows at or before it; ties get distinct shares."""
    ranked = rank_rows(df.select(*group, key, error), [error, key], group, "rn", "n")
    return ranked.select(*group, error, (F.col("rn") / F.col("n")).alias("cdf"))


def error_percentiles(df: DataFrame, error: str, group: Sequence[str] = ()) -> DataFrame:
    """Errors at which the empirical CDF reaches 50 % and 80 %."""
    return discrete_quantiles(distribution(df, error, group), error, {"p50": 0.5, "p80": 0.8}, group)


def box_stats(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers at 1.5 IQR, outliers."""
    dist = distribution(df, value, group)
    box = materialize(quantiles(dist, value, {"q1": 0.25, "med": 0.5, "q3": 0.75}, group), "boxes")
    v, q1, q3 = F.col(value), F.col("q1"), F.col("q3")
    reach = 1.5 * (q3 - q1)
    low, high = v >= q1 - reach, v <= q3 + reach
    return dist.drop("n").join(box, list(group)).groupBy(*group, "n", "q1", "med", "q3").agg(
        F.least(F.min(F.when(low, v)), F.first("q1")).alias("whisker_lo"),
        F.greatest(F.max(F.when(high, v)), F.first("q3")).alias("whisker_hi"),
        F.sum(F.when(low & high, 0).otherwise(F.col("cnt"))).alias("n_outliers"),
    )


def boxes_per_expert(df: DataFrame, values: Sequence[str], slots: int = EXPERT_SLOTS) -> DataFrame:
    """Boxes of each value over the samples an expert wins; losers stay as empty rows.

    ``slots`` is the least number of experts reported; all that win are.
    """
    out = None
    for value in values:
        boxes = box_stats(
            df.select(F.col("best_model_idx").alias("expert_id"), F.col(value).cast("double").alias("v")),
            "v", ["expert_id"],
        )
        all_slots = df.sparkSession.range(slots).select(F.col("id").cast("int").alias("expert_id"))
        part = all_slots.join(boxes, "expert_id", "full").withColumn("quantity", F.lit(value))
        part = part.withColumn("n", F.coalesce("n", F.lit(0)))
        out = part if out is None else out.unionByName(part)
    return out


def uncertainty_bin(u: Column) -> Column:
    """[0, 3], (3, 5], (5, inf); NULL below 0."""
    return (
        F.when((u >= 0) & (u <= 3), UNCERTAINTY_BINS[0])
        .when((u > 3) & (u <= 5), UNCERTAINTY_BINS[1])
        .when(u > 5, UNCERTAINTY_BINS[2])
    )


def uncertainty_bin_boxes(df: DataFrame, band: str = "band") -> DataFrame:
    """Boxes of the absolute error per fixed uncertainty bin and band.

    A bin that occurs in any band is reported for all of them, with n = 0 where
    it is empty.
    """
    binned = df.withColumn("bin", uncertainty_bin(F.col("uncertainty"))).where(F.col("bin").isNotNull())
    return _filled(box_stats(binned, "abs_error", [band, "bin"]), band, "bin")


def _all_combinations(counts: DataFrame, band: str, group: str) -> DataFrame:
    """Every band with every group that occurs in some band; at most a few rows."""
    counts = materialize(counts, "rates")
    frame = counts.select(F.collect_set(band).over(_whole()).alias("_bands"), group).distinct()
    frame = frame.select(group, F.explode("_bands").alias(band))
    return frame.join(counts, [band, group], "left")


def _filled(boxes: DataFrame, band: str, group: str) -> DataFrame:
    return _all_combinations(boxes, band, group).withColumn("n", F.coalesce("n", F.lit(0)))


def _whole() -> WindowSpec:
    return Window.partitionBy(F.lit(0))


def high_error_probability(df: DataFrame, limit: float = HIGH_ERROR_DB, band: str = "band") -> DataFrame:
    """Share (%) of errors above ``limit`` per fixed uncertainty bin and band.

    A bin that occurs in any band is reported for all of them.
    """
    binned = df.withColumn("bin", uncertainty_bin(F.col("uncertainty"))).where(F.col("bin").isNotNull())
    rates = binned.groupBy(band, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("abs_error") > limit).alias("n_high")
    )
    full = _all_combinations(rates, band, "bin")
    n, n_high = F.coalesce("n", F.lit(0)), F.coalesce("n_high", F.lit(0))
    return full.select(
        band, "bin", n.alias("n"), F.when(n > 0, 100.0 * n_high / n).otherwise(F.lit(0.0)).alias("pct_high")
    )


def with_quantile_group(df: DataFrame, band: str = "band") -> DataFrame:
    """low / mid / high by the 20 % and 80 % quantiles of uncertainty in the band.

    A row without an uncertainty is in no segment and is left out.
    """
    cuts = materialize(
        quantiles(distribution(df, "uncertainty", [band]), "uncertainty", {"q20": 0.2, "q80": 0.8}, [band]),
        "cuts",
    )
    u = F.col("uncertainty")
    return (
        df.join(cuts.drop("n"), band)
        .withColumn(
            "segment",
            F.when(u <= F.col("q20"), QUANTILE_GROUPS[0])
            .when(u <= F.col("q80"), QUANTILE_GROUPS[1])
            .when(u > F.col("q80"), QUANTILE_GROUPS[2]),
        )
        .where(F.col("segment").isNotNull())
        .drop("q20", "q80")
    )


def quantile_boxes(df: DataFrame, band: str = "band") -> DataFrame:
    """Boxes of the absolute error per segment and band, n = 0 where one is empty."""
    return _filled(box_stats(with_quantile_group(df, band), "abs_error", [band, "segment"]), band, "segment")


def quantile_high_error_rate(df: DataFrame, rho: float, band: str = "band") -> DataFrame:
    """Row count and share (%) of errors above ``rho`` per segment and band."""
    counts = with_quantile_group(df, band).groupBy(band, "segment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("abs_error") > rho).alias("_high")
    )
    full = _filled(counts, band, "segment")
    rate = F.when(F.col("n") > 0, 100.0 * F.col("_high") / F.col("n")).otherwise(F.lit(0.0))
    return full.select(band, "segment", "n", rate.alias("pct_high"))


def top_uncertainty_trend(df: DataFrame, rho: float) -> DataFrame:
    """Error rate among the most uncertain 10, 20, ... 100 % of rows.

    Rows are counted once per distinct uncertainty; the ten cumulative figures
    are then sums over that short form.
    """
    tens = range(10, 101, 10)
    dist = distribution(df, "uncertainty")
    cuts = quantiles(dist, "uncertainty", {f"p{p}": 1.0 - p / 100.0 for p in tens}).first()
    by_value = df.groupBy("uncertainty").agg(
        F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("abs_error") > rho).alias("high")
    )
    sums = []
    for p in tens:
        inside = F.col("uncertainty") >= F.lit(cuts[f"p{p}"])
        sums += [F.sum(F.when(inside, F.col("cnt"))).alias(f"n{p}"), F.sum(F.when(inside, F.col("high"))).alias(f"h{p}")]
    rows = F.array(*[F.struct(F.lit(p).alias("top_pct"), F.col(f"n{p}").alias("n"), F.col(f"h{p}").alias("h")) for p in tens])
    return (
        by_value.agg(*sums)
        .select(F.inline(rows))
        .select("top_pct", "n", F.when(F.col("n") > 0, 100.0 * F.col("h") / F.col("n")).otherwise(0.0).alias("pct_high"))
    )


def _decile(rank: Column, total: Column) -> Column:
    """Stratum 0..9 of a 1-based rank; stratum i starts at floor(i * 0.1 * n)."""
    start = [F.floor(F.lit(i) * 0.1 * total) for i in range(1, 10)]
    stratum = F.lit(0)
    for edge in start:
        stratum = stratum + (rank - 1 >= edge).cast("int")
    return stratum


def decile_strata(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Add ``stratum`` 0..9 by position in ``order``."""
    ranked = rank_rows(df, order, (), "_rn", "_n")
    return ranked.withColumn("stratum", _decile(F.col("_rn"), F.col("_n"))).drop("_rn", "_n")


def top_error_distribution(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Where the worst tenth of errors falls in the uncertainty deciles (%)."""
    limit = quantiles(distribution(df, "abs_error"), "abs_error", {"q90": 0.9}).first()["q90"]
    strata = decile_strata(df.select(key, "uncertainty", "abs_error"), [F.desc("uncertainty"), key])
    counts = strata.groupBy("stratum").agg(F.count_if(F.col("abs_error") > limit).alias("n_bad"))
    total = F.sum("n_bad").over(_whole())
    return (
        counts.withColumn("total_bad", total)
        .where(F.col("total_bad") > 0)
        .select("stratum", "n_bad", (100.0 * F.col("n_bad") / F.col("total_bad")).alias("pct"))
    )


def filter_bad_points(df: DataFrame, threshold: float, at_least: int) -> DataFrame:
    """Rows with an error above ``threshold``; empty when fewer than ``at_least``."""
    bad = df.where(F.col("abs_error") > threshold)
    enough = bad.limit(at_least).count() >= at_least
    return bad if enough else bad.limit(0)


def oracle_cdf(df: DataFrame, models: Sequence[str], key: str = "sample_id") -> DataFrame:
    """Error CDF of the best expert per sample and of every single expert."""
    oracle = best_expert(df, models).select(
        key, F.lit("oracle").alias("model"), F.col("best_model_error").alias("error")
    )
    singles = to_long(df, models, key, "rssi").select(
        key,
        F.concat(F.lit("model_"), F.col("expert_id")).alias("model"),
        F.abs(F.col("pred") - F.col("rssi")).alias("error"),
    )
    errors = oracle.unionByName(singles).withColumn("error", F.round("error", 9))
    return error_cdf(errors, "error", key, ["model"])
